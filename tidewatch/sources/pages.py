"""Readable text from crawled pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Elements never shown as text, elements that end a line, void elements.
_HIDDEN = {"script", "style", "nav", "noscript", "template", "aside", "footer", "form", "iframe", "head"}
_BLOCK = {"p", "br", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "blockquote", "pre"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_AD_CLASSES = {"ad", "ads", "advert", "advertisement", "sponsored"}


class _Reader(HTMLParser):
    """Collects visible text, once for the article element and once for the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.article: list[str] = []
        self.body: list[str] = []
        self._articles = 0
        self._hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self._hidden:
            if tag == self._hidden[0] and tag not in _VOID:
                self._hidden.append(tag)
            return
        classes = set((dict(attrs).get("class") or "").lower().split())
        if tag not in _VOID and (tag in _HIDDEN or classes & _AD_CLASSES):
            self._hidden.append(tag)
        elif tag == "article":
            self._articles += 1
        if tag in _BLOCK:
            self._put("\n")

    def handle_endtag(self, tag):
        if self._hidden:
            if tag == self._hidden[0]:
                self._hidden.pop()
        elif tag == "article":
            self._articles = max(0, self._articles - 1)
        elif tag in _BLOCK:
            self._put("\n")

    def handle_data(self, data):
        if not self._hidden:
            self._put(data)

    def _put(self, text):
        self.body.append(text)
        if self._articles:
            self.article.append(text)


def readable_text(html: str | None) -> str | None:
    """Visible text of the article element, or of the whole page without one."""
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    reader.close()
    lines = "".join(reader.article or reader.body).split("\n")
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def extract_text(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, text) for every page, whole documents, one Arrow batch at a time."""
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([readable_text(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [key, "text"])

    return pages.select(key, html).mapInArrow(run, f"{key} {key_type}, text string")


def page_fetcher(pages: DataFrame, version: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetcher over crawled pages: ``fetch(urls) -> (url, text)`` parses only those asked for.

    A url crawled more than once gives its newest page by ``version``, or without one the
    greatest html: one row per url in any case, so no event is multiplied.
    """
    return lambda urls: extract_text(latest_pages(pages.join(urls, "url", "left_semi"), version or "html"))


def latest_pages(pages: DataFrame, version: str) -> DataFrame:
    """One crawl per url: the newest.  The limit also runs before the shuffle."""
    order = W.partitionBy("url").orderBy(F.col(version).desc(), F.col("html").desc())
    return pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
