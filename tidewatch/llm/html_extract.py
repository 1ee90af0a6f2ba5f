"""HTML extraction with a site style tree.

1. Every page is cut once into text blocks.  A block knows its style path: the chain of open
   elements, each written as its tag with class and id (digits folded), and whether HTML itself
   says that it is no part of the article (navigation, headers, footers, forms, scripts, and
   class or id names of adverts, sidebars, notices, comments and the like).
2. The blocks of all pages of one host are merged into its style tree: a node is a style path.
   Its presentation importance is the entropy of how many of its children styles pages show; its
   content importance is the entropy of its contents over the pages that have it, both relative
   to the logarithm of the number of those pages.  Template text has low entropy: it repeats.
   The importance of a branch is composed from below: the mean of the importances of its nodes
   with text, weighted by the pages that show them.  Nodes without text of their own have one too.
3. The text of a node of at least ``MIN_PAGES`` pages and an importance below ``LEAST_IMPORTANCE`` is
   removed from every page of the host.  A branch of that many pages is noise, and goes as a whole,
   if it and every node in it are of that low an importance: so go the parts of a template that
   only few pages show.  Nodes of articles are important to the branches around them.  Pages of one content count once, so copies
   are no evidence of a template.  In an ``article`` or ``main`` element the page itself says that
   it is the article: there ``MIN_PAGES_IN_SCOPE`` pages and ``LEAST_IN_SCOPE`` are asked for, nodes are
   removed one by one, and ``TITLES`` stay, for a shared title is still the articles'.

Statistics are combined before each shuffle by (host, path, content hash), so a host with a third
of all pages costs no task more than others; no block's text is shuffled for the tree.  Removals, a
few paths per host, are broadcast if all of them take at most ``SHIPPED`` bytes; beyond that pages
and removals meet by host and salt.

A page that has an article (or main) element keeps what the tree leaves in it.  Several sibling
articles that all link away and hold at most one paragraph are cards, not the article; a page of
cards keeps, like a page without such elements, what is left of the whole body.  A form that holds
an h1, article or main, or all the text of its page, is a wrapper of the page and no form.  Blocks
are block-level elements and line breaks are white space inside them; character references are
decoded after parsing; white space becomes one space.

Parsing takes time in proportion to the page, whatever stays open: the open elements are indexed by
what closes them, and a quote that never closes is looked for once.

Defined results: null and empty html give empty text; broken markup is read as far as it goes:
unclosed paragraphs and items end where the next begins, and after a tag whose quotes never close
quotes no longer protect a ``>``; a host of few pages is left to the rules
of 1; repeated rows and null ids or urls each get their row.  Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

MIN_PAGES, LEAST_IMPORTANCE = 8, 0.3
MIN_PAGES_IN_SCOPE, LEAST_IN_SCOPE = 16, 0.1
SHIPPED, SALTS = 32 << 20, 64

#: HTML's elements by how they are treated.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: HTML's raw text: what follows is text up to the closing tag, or to the end of the page.
RAW = frozenset("script style textarea title iframe xmp noembed".split())
FOREIGN, HTML_INSIDE = frozenset(["svg", "math"]), frozenset(["foreignobject", "desc", "title", "annotation-xml"])
#: Elements whose text is never read, with all they hold.
MUTE = frozenset("noscript template object select button".split()) | FOREIGN
OUTSIDE = frozenset("nav header footer aside menu dialog head label".split()) | MUTE
#: HTML elements that end svg and math they stand in.
_BREAKS_OUT = BLOCKS | frozenset("b big br code em embed head i img meta nobr ruby s small span strong strike sub sup tt u var".split())
SCOPES = frozenset(["article", "main"])
TITLES = frozenset(["h1", "h2"])
#: An element that ends an open one of the same group.
_ENDS = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
         "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: What an element's start closes: the tags it may end.
_ENDED_BY = {tag: [above for above, by in _ENDS.items() if tag in by] for tag in {t for by in _ENDS.values() for t in by}}
#: Words of class, id or role that say "not the article", and words that may stand beside them in one name.
_NAMES = re.compile(r"""ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?
|header|masthead|footer|foot|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|comments?|replies|reply|disqus|discussion|respond
|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|form|widget|pagination|pager|toolbar|skip|copyright|legal
|complementary|contentinfo|hidden""".replace("\n", ""), re.I)
_BESIDE = frozenset("""a about area arrow author bar block blocks body bottom box btn button buttons card cards close col column container content
count en entry field global grid group head heading icon icons in info inline inner input item items js label layer left level like line
link links list lists main mobile more next nested new of on outer page pane panel parent part post posts prev primary right row secondary section
site sticky slot small stories story sub text thread title to toggle top unit up user users view wide wrap wrapper zone""".split())
#: Names that hold one of those words and still are the article's.
_KEPT = re.compile(r"(?:article|post|entry|content|main|story|text)(?:[_-]?(?:header|body|content|text))?", re.I)
_PARTS = re.compile(r"[_-]+")

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|href)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_DIGITS = re.compile(r"\d+")
#: Comments and raw text, to their ends.
_SKIPPED = rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?(?:</\2(?=[\s/>])|\Z)"


@lru_cache(1 << 14)
def _says_outside(names: str) -> bool:
    """Whether a class, id or role names what is no article.

    A name counts as a whole: all its parts are such words or words that stand beside them, so
    that ``sidebar-left`` counts and ``social-science`` does not.
    """
    tokens = names.split()
    if any(_KEPT.fullmatch(token) for token in tokens):
        return False
    for token in tokens:
        parts = [part for part in _PARTS.split(_DIGITS.sub("", token.lower())) if part]
        if any(map(_NAMES.fullmatch, parts)) and all(part in _BESIDE or _NAMES.fullmatch(part) for part in parts):
            return True
    return False


@lru_cache(1 << 16)
def _path(parent: int, style: str) -> int:
    """The hash chain that names a node: its parent's hash and its own style, at any depth."""
    return int.from_bytes(blake2b(style.encode("utf-8", "replace"), digest_size=8, key=parent.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


class _Scope:
    """An open article or main element; ``live`` in the end if it, or one around it, is no card."""

    def __init__(self, tag: str, parent: int, outer: _Scope | None) -> None:
        self.tag, self.parent, self.outer = tag, parent, outer
        self.links = self.live = False
        self.paragraphs = 0

    def may_be_card(self) -> bool:
        return self.tag == "article" and self.links and self.paragraphs <= 1


class _Form:
    def __init__(self) -> None:
        self.wraps = False


class _Page:
    """The blocks of one page in order: (path, text, in the article's scope, outside by HTML's own word, removed, path of the nearest node outside of articles)."""

    def __init__(self, html: str, removed: frozenset[int] = frozenset(), branches: frozenset[int] = frozenset()):
        self.blocks: list[tuple[int, str, bool, bool, bool, int]] = []
        self.above: dict[int, int] = {}
        # tag, path, scope, outside, text is not read, without a closing tag, removed by the tree, number, form, parent's entry,
        # path of the nearest node outside of articles
        self.open: list[tuple] = [("", 0, None, False, False, False, 0, 0, None, None, 0)]
        self.found: list[tuple] = []
        self.text: list[str] = []
        self.scopes: list[_Scope] = []
        self.unclosed: dict[str, set[int]] = {}
        self.html, self.removed, self.branches, self.numbers, self.quoted = html, removed, branches, 0, True
        self.last_end = html.rfind(">")
        # Depths of open elements, by what has to be found among them.
        self.by_tag: dict[str, list[int]] = {}
        self.block_at, self.hard_at, self.scope_at = [0], [-1], [-1]
        self.foreign_at, self.inside_at, self.unclosed_at = [], [-1], []
        self._read(html)
        self._flush()
        self._decide()

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                self.found.append((text, self.open[self.block_at[-1]]))

    def _decide(self) -> None:
        """What only the whole page tells: which articles are cards, and which forms are wrappers."""
        siblings: dict[int, list[_Scope]] = {}
        for scope in self.scopes:
            if scope.tag == "article":
                siblings.setdefault(scope.parent, []).append(scope)
        cards = {id(s) for group in siblings.values() if len(group) > 1 and all(s.may_be_card() for s in group) for s in group}
        for scope in self.scopes:
            scope.live = id(scope) not in cards or scope.outer is not None and scope.outer.live
        in_form = [entry[8] is not None and not entry[8].wraps for _, entry in self.found]
        forms_count = any(not entry[3] and not form for (_, entry), form in zip(self.found, in_form))
        for (text, entry), form in zip(self.found, in_form):
            self.blocks.append((entry[1], text, entry[2] is not None and entry[2].live, entry[3] or form and forms_count, entry[6] > 0, entry[10]))
        self._climb()

    def _climb(self) -> None:
        """``above``: the parent of every node outside of articles that shows text, or has such nodes below."""
        seen = set()
        for (_, entry), block in zip(self.found, self.blocks):
            while not block[3] and entry[9] is not None and entry[7] not in seen:
                seen.add(entry[7])
                if entry[2] is None:
                    self.above[entry[1]] = entry[9][1]
                entry = entry[9]

    def _push(self, entry: tuple) -> None:
        depth, tag = len(self.open), entry[0]
        self.open.append(entry)
        self.by_tag.setdefault(tag, []).append(depth)
        if tag in BLOCKS:
            self.block_at.append(depth)
            if tag != "p":
                self.hard_at.append(depth)
        if tag in SCOPES:
            self.scope_at.append(depth)
        if tag in FOREIGN:
            self.foreign_at.append(depth)
        if tag in HTML_INSIDE:
            self.inside_at.append(depth)
        if entry[5]:
            self.unclosed_at.append(depth)

    def _close(self, depth: int) -> None:
        if self.block_at[-1] >= depth:
            self._flush()
        for entry in self.open[depth:]:
            self.by_tag[entry[0]].pop()
        del self.open[depth:]
        for places in (self.block_at, self.hard_at, self.scope_at, self.foreign_at, self.inside_at, self.unclosed_at):
            while places and places[-1] >= depth:
                places.pop()

    def _foreign(self) -> bool:
        return self.open[-1][4] and bool(self.foreign_at)

    def _break_out(self, tag: str) -> None:
        """Ends muted elements that cannot hold this one: svg and math, and those that never close."""
        ends = self.unclosed_at[:1] if tag in BLOCKS else []
        if tag in _BREAKS_OUT:
            first = bisect_right(self.foreign_at, self.inside_at[-1])
            ends = ends + self.foreign_at[first:first + 1]
        if ends:
            self._close(min(ends))

    def _never_closes(self, tag: str, at: int) -> bool:
        """Whether no closing tag belongs to the element whose start tag begins at this place."""
        if tag not in self.unclosed:
            waiting: list[int] = []
            for found in re.finditer(rf"<(/?){tag}(?=[\s/>])|{_SKIPPED}", self.html, re.I | re.S):
                if found[1] == "":
                    waiting.append(found.start())
                elif found[1] and waiting:
                    waiting.pop()
            self.unclosed[tag] = set(waiting)
        return at in self.unclosed[tag]

    def _start(self, tag: str, attributes: str, at: int) -> None:
        if self.open[-1][4]:
            self._break_out(tag)
        ended = [self.by_tag[above][-1] for above in _ENDED_BY.get(tag, ()) if self.by_tag.get(above)]
        if ended and max(ended) >= self.hard_at[-1]:
            self._close(max(ended))
        if tag in BLOCKS:
            self._flush()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        muted = tag in MUTE
        unclosed = muted and tag not in FOREIGN and self._never_closes(tag, at)
        if attributes.endswith("/") and (unclosed or tag in FOREIGN or self._foreign()):
            return
        parent = self.open[-1]
        _, path, scope, outside, mute, _, removed, number, form, _, anchor = parent
        named, hidden = "", False
        for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif key in ("class", "id", "role"):
                named += " " + value
            elif key == "href" and tag == "a" and scope is not None and value and not value.startswith("#"):
                scope.links = True
        if tag == "p" and scope is not None:
            scope.paragraphs += 1
        ruled = tag in OUTSIDE and not (tag == "header" and scope is not None)
        if named and tag not in ("html", "body", "main", "form"):
            ruled |= _says_outside(named)
        if tag in SCOPES:
            scope = _Scope(tag, number, scope)
            self.scopes.append(scope)
        if tag == "form":
            form = _Form()
        if tag in SCOPES or tag == "h1":
            for depth in reversed(self.by_tag.get("form", ())):
                if self.open[depth][8].wraps:
                    break
                self.open[depth][8].wraps = True
        style = _DIGITS.sub("0", ".".join([tag, *named.lower().split()]))
        path = _path(path, style)
        branch = scope is None and (removed > 1 or path in self.branches)  # 2: with all below, 1: the text of the node alone
        removed = 2 if branch else int(path in self.removed and (scope is None or tag not in TITLES))
        self.numbers += 1
        anchor = path if scope is None else anchor
        self._push((tag, path, scope, ruled or hidden or outside, muted or mute, unclosed, removed, self.numbers, form, parent, anchor))

    def _end(self, tag: str) -> None:
        places = self.by_tag.get(tag)
        if places and (tag in BLOCKS or places[-1] > self.scope_at[-1]):
            self._close(places[-1])

    def _tag_end(self, start: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``start``, or -1."""
        if start > self.last_end:
            return -1
        at = start
        while self.quoted:
            found = _STOP.search(self.html, at)
            if found is None:
                self.quoted = False
            elif found[0] == ">":
                return found.start()
            else:
                at = self.html.find(found[0], found.end()) + 1
                self.quoted = at > 0
        return self.html.find(">", start)

    def _say(self, text: str) -> None:
        if not self.open[-1][4]:
            self.text.append(unescape(text) if "&" in text else text)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self._say(html[at:])
                return
            if mark > at:
                self._say(html[at:mark])
            if html.startswith("<!--", mark):
                end = html.find("-->", mark + 4)
                at = end + 3 if end >= 0 else size
                continue
            if html.startswith(("<!", "<?"), mark):
                end = html.find(">", mark)
                at = end + 1 if end >= 0 else size
                continue
            name = _TAG.match(html, mark)
            end = self._tag_end(name.end()) if name else -1
            if end < 0:
                self._say("<")
                at = mark + 1
                continue
            tag, at = name[2].lower(), end + 1
            if name[1]:
                if tag == "br":
                    self.text.append(" ")
                self._end(tag)
            elif tag in RAW and not self._foreign():
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else size
            else:
                self._start(tag, html[name.end():end], mark)

    def main_text(self) -> str:
        """What stays of the page."""
        left = [(text, scope) for _, text, scope, outside, removed, _ in self.blocks if not (outside or removed)]
        if any(scope for _, scope in left):
            left = [(text, scope) for text, scope in left if scope]
        return "\n".join(text for text, _ in left)


def _pages(pages: DataFrame, url_column: str, html_column: str, keep: tuple[str, ...]) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_column), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return pages.select(*keep, F.col(url_column).alias("url"), host.alias("host"), F.col(html_column).alias("html"))


def _fields(rows: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in without)


def blocks(pages: DataFrame, url_column: str = "url", html_column: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns, url, host, the page's blocks and its nodes outside of articles."""
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = pa.list_(pa.struct([("path", pa.int64()), ("text", pa.string()), ("scope", pa.bool_()), ("outside", pa.bool_()), ("anchor", pa.int64())]))
        node = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64())]))
        for batch in batches:
            found, nodes = [], []
            for html in batch.column("html").to_pylist():
                page = _Page(html or "")
                found.append([{"path": path, "text": text, "scope": scope, "outside": outside, "anchor": anchor}
                              for path, text, scope, outside, _, anchor in page.blocks])
                nodes.append([{"path": path, "parent": parent} for path, parent in page.above.items()])
            yield batch.drop_columns(["html"]).append_column("blocks", pa.array(found, block)).append_column("nodes", pa.array(nodes, node))

    rows = _pages(pages, url_column, html_column, keep)
    kinds = ("array<struct<path:bigint,text:string,scope:boolean,outside:boolean,anchor:bigint>>", "array<struct<path:bigint,parent:bigint>>")
    return rows.mapInArrow(cut, _fields(rows, "html") + ", blocks {}, nodes {}".format(*kinds))


def shown(cut: DataFrame) -> DataFrame:
    """(host, blocks, nodes) of the pages with a host: blocks that are not outside, texts as hashes."""
    block = F.transform(F.filter("blocks", lambda b: ~b["outside"]), lambda b: F.struct(
        b["path"].alias("path"), b["scope"].alias("scope"), b["anchor"].alias("anchor"), F.xxhash64(b["text"]).alias("text")))
    return cut.where("host <> ''").select("host", block.alias("blocks"), "nodes")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, scope, anchor, pages, presentation, content): the nodes with text of each host's tree.

    Both entropies are relative to log(pages), so they lie between 0 (the same everywhere) and 1;
    what one page alone shows has 1.
    """
    page = pages.withColumn("page", F.xxhash64("blocks")).groupBy("host", "page").agg(F.first("blocks").alias("blocks"))
    node = (page.select("host", "page", F.explode("blocks").alias("b")).groupBy("host", "page", "b.path")
            .agg(F.max("b.scope").alias("scope"), F.max("b.anchor").alias("anchor"), F.count("*").alias("n"), F.sum(F.col("b.text").cast("decimal(38,0)")).alias("content")))

    def entropy(column: str) -> DataFrame:
        same = node.groupBy("host", "path", column).agg(F.count("*").alias("pages"), F.max("scope").alias("scope"), F.max("anchor").alias("anchor"))
        return same.groupBy("host", "path").agg(
            F.max("scope").alias("scope"),
            F.max("anchor").alias("anchor"),
            F.sum("pages").alias("pages"),
            (F.log(F.sum("pages")) - F.sum(F.col("pages") * F.log("pages")) / F.sum("pages")).alias("bits"))

    shown, held = entropy("n"), entropy("content").withColumnRenamed("bits", "content_bits").drop("pages", "scope", "anchor")

    def relative(bits: str) -> Column:
        return F.when(F.col("pages") > 1, F.col(bits) / F.log("pages")).otherwise(1.0)

    return shown.join(held, ["host", "path"]).select(
        "host", "path", "scope", "anchor", "pages", relative("bits").alias("presentation"), relative("content_bits").alias("content"))


def branches(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance, highest) of every branch outside of articles, composed from the nodes with
    text in it: the mean of their importances by pages, and the greatest one.

    Sums go up the tree by pointer doubling: after round i a node has those of all nodes less than
    2^i below it, so the rounds follow the logarithm of the depth.
    """
    edges = pages.select("host", F.inline("nodes")).groupBy("host", "path").agg(F.min("parent").alias("up"))
    importance = F.when(F.col("scope"), 1.0).otherwise(F.greatest("presentation", "content"))
    own = tree.groupBy("host", F.col("anchor").alias("path")).agg(
        F.sum(F.col("pages") * importance).alias("weighed"), F.sum("pages").alias("weight"), F.max("pages").alias("pages"), F.max(importance).alias("highest"))
    sums = {"weighed": F.sum, "weight": F.sum, "pages": F.max, "highest": F.max}
    totals = materialise(edges.join(own, ["host", "path"], "left").select(
        "host", "path", F.nullif("up", F.lit(0)).alias("up"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums]), "branches")
    while not totals.where("up is not null").isEmpty():
        below = totals.where("up is not null").groupBy("host", F.col("up").alias("path")).agg(*[how(c).alias(f"_{c}") for c, how in sums.items()])
        further = totals.where("up is not null").select("host", F.col("path").alias("up"), F.col("up").alias("_up"))
        joined = totals.join(below, ["host", "path"], "left").join(further, ["host", "up"], "left")
        added = [(F.greatest(c, f"_{c}") if how is F.max else F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c, how in sums.items()]
        totals = materialise(joined.select("host", "path", F.col("_up").alias("up"), *added), "branches")
    return totals.where("weight > 0").select("host", "path", "pages", (F.col("weighed") / F.col("weight")).alias("importance"), "highest")


def removals(cut: DataFrame) -> DataFrame:
    """(host, paths, branches): the nodes and the branches of low importance of each host."""
    known = materialise(shown(cut), "shown-blocks")
    tree = materialise(style_tree(known), "style-tree")
    pages, least = (F.when(F.col("scope"), F.lit(inside)).otherwise(F.lit(other)) for inside, other in (
        (MIN_PAGES_IN_SCOPE, MIN_PAGES), (LEAST_IN_SCOPE, LEAST_IMPORTANCE)))
    alone = tree.where((F.col("pages") >= pages) & (F.greatest("presentation", "content") < least)).select("host", "path", F.lit(False).alias("whole"))
    whole = branches(tree, known).where((F.col("pages") >= MIN_PAGES) & (F.col("highest") < LEAST_IMPORTANCE)).select("host", "path", F.lit(True).alias("whole"))
    return alone.union(whole).groupBy("host").agg(
        F.collect_list(F.when(~F.col("whole"), F.col("path"))).alias("paths"), F.collect_list(F.when(F.col("whole"), F.col("path"))).alias("branches"))


def _with_removals(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pages beside their host's removals.  A page without a host has none and meets nobody."""
    held = found.agg(F.coalesce(F.sum(8 * (F.size("paths") + F.size("branches")) + F.length("host") + 64), F.lit(0))).first()[0]
    if held <= SHIPPED:
        return rows.join(F.broadcast(found), "host", "left").drop("host")
    salt = F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit(" "), F.xxhash64("html").cast("string")))
    return rows.withColumns({"host": own, "_salt": salt}).join(salted, ["host", "_salt"], "left").drop("host", "_salt")


def extract(pages: DataFrame, url_column: str = "url", html_column: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns, url and the main text of each page."""
    # Pages are parsed once for the tree and once for their text, so that texts need not be stored.
    found = materialise(removals(blocks(pages, url_column, html_column, ())), "removals")
    rows = _with_removals(_pages(pages, url_column, html_column, keep), found)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "paths", "branches"))
            texts = [_Page(html, frozenset(alone or ()), frozenset(whole or ())).main_text() if html else ""
                     for html, alone, whole in zip(*columns, strict=True)]
            yield batch.drop_columns(["html", "paths", "branches"]).append_column("text", pa.array(texts, pa.string()))

    return rows.mapInArrow(read, _fields(rows, "html", "paths", "branches") + ", text string")
