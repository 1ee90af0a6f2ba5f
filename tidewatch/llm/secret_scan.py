"""Secret scans in DataFrame functions only: patterns, and a randomness test battery.

Three base kinds are patterns.  The method adds tokens that look random: every run of at least
``LEAST`` characters of the encodings is a candidate; its encoding is inferred from its
characters (hex of one case, base32, letters of one case with digits, or base64 with capitals, small
letters and digits; plain numbers and tokens without a digit have none).  A battery tests the hypothesis "drawn at random from the
encoding's alphabet": chi-squared over equal cells of the alphabet, runs above and below its
middle, and serial correlation; Fisher's method combines the three p-values.

False discoveries are controlled by length: within each (encoding, length stratum), over all
documents, the share of random tokens is estimated from the p-values above one half, and the
p-value from which a token counts as a secret is the least at which the estimated share of
non-random tokens stays below ``FALSE_SHARE``.  Short tokens, whose tests have little power,
so meet a stricter cut.  The cuts are at most ``len(ALPHABETS) * STRATA`` numbers, whatever the data.

Defined results: null and empty texts have no spans; spans are code points, end exclusive;
added spans never overlap base ones, base kinds may overlap one another; repeated rows and null
ids each get their row.  All columns of the input stay; only ``text`` is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

LEAST, STRATA, CELLS_OF_P, FALSE_SHARE = 20, 12, 50, 0.1
_CHARACTERS = "[A-Za-z0-9+/_=-]"
CANDIDATE = _CHARACTERS + "{%d,}" % LEAST
#: Alphabets in the order of their symbols, and the equal cells chi-squared counts.
ALPHABETS = {
    "hex": ("0123456789abcdef", 16),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 8),
    "lower36": ("0123456789abcdefghijklmnopqrstuvwxyz", 9),
    "upper36": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 9),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 8),
}

_SPAN = "array<struct<start:int,end:int,match:string>>"
#: Code points of a piece of text that spans are cut from.
PIECE = 1_024


def _scan(values: Column, of: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of ints: ``of`` sums up an array, ``both`` two totals.

    The array is cut into about sqrt(n) runs.  A run's totals so far and a place's within its run
    take a slice each, so the work is n sqrt(n) for n values and nothing is copied along.
    """
    def over(given: Column) -> Column:
        width, one = given["width"], F.lit(1)
        starts = F.sequence(F.lit(0), F.size(given["values"]) - 1, width)
        runs = F.transform(starts, lambda at: F.slice(given["values"], at + one, width))

        def totals(cut: Column) -> Column:
            def run(values: Column, number: Column) -> Column:
                before = F.slice(cut["sums"], F.lit(1), number)
                return F.transform(values, lambda _, i: F.when(number == 0, of(F.slice(values, F.lit(1), i + 1))).otherwise(
                    both(of(before), of(F.slice(values, F.lit(1), i + 1)))))
            return F.flatten(F.transform(cut["runs"], run))

        return _once(runs, lambda cut: _once(F.struct(cut.alias("runs"), F.transform(cut, of).alias("sums")), totals))

    width = F.ceil(F.sqrt(F.size(values))).cast("int")
    none = F.array().cast("array<int>")
    return F.when(F.size(values) > 0, _once(F.struct(values.alias("values"), width.alias("width")), over)).otherwise(none)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, x: total + x)


def _spans(text: Column, pattern: str, present: Column) -> Column:
    """Leftmost non-overlapping matches with their positions: what splits the text, between what it splits off."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        steps = F.transform(found["matches"], lambda m, i: F.length(m) + F.length(F.get(found["gaps"], i)))
        return _once(_scan(steps, _sum, lambda a, b: a + b), lambda ends: F.transform(found["matches"], lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"))))

    none = F.array().cast(_SPAN)
    found = _once(F.struct(matches.alias("matches"), gaps.alias("gaps")), placed)
    return F.when(present & (F.size(matches) > 0), found).otherwise(none)


def _normal(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def encoding(token: Column) -> Column:
    """The narrowest of ``ALPHABETS`` that fits, or null for what is in none of them."""
    digit, upper, lower = token.rlike("[0-9]"), token.rlike("[A-Z]"), token.rlike("[a-z]")
    return (F.when(~digit | ~(upper | lower), None)
            .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
            .when(token.rlike("^[a-z0-9]+$"), "lower36")
            .when(token.rlike("^[A-Z0-9]+$"), "upper36")
            .when(upper & lower, "base64"))


def _of(name: Column, values: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), name)


def _codes(token: Column, name: Column, alphabet: Column) -> Column:
    """Symbol numbers of a token; padding and the url forms of base64 are put aside or mapped."""
    plain = F.when(name == "hex", F.lower(token)).otherwise(F.translate(F.rtrim(token, F.lit("=")), "-_", "+/"))
    return F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.position(c, alphabet) - 1)


def _battery(drawn: Column) -> Column:
    """Combined p-value of the three tests for ``codes``, symbol numbers below ``size``, and ``cells``."""
    def counted(d: Column) -> Column:
        n, half = F.size(d["codes"]).cast("double"), d["size"] / 2
        firsts, seconds = F.slice(d["codes"], F.lit(1), F.size(d["codes"]) - 1), F.slice(d["codes"], F.lit(2), F.size(d["codes"]) - 1)
        chi = _once(F.transform(d["codes"], lambda v: F.floor(v * d["cells"] / d["size"]).cast("int")), lambda numbers: F.aggregate(
            F.sequence(F.lit(0), d["cells"] - 1), F.lit(0.0), lambda total, cell: total + F.pow(
                F.size(F.filter(numbers, lambda v: v == cell)) - n / d["cells"], F.lit(2.0)) / (n / d["cells"])))
        centre = (d["size"] - 1) / 2
        return F.struct(
            n.alias("n"), d["size"].alias("size"), (d["cells"] - 1).alias("df"), chi.alias("chi"),
            F.size(F.filter(d["codes"], lambda v: v >= half)).cast("double").alias("highs"),
            (1 + F.size(F.filter(F.zip_with(firsts, seconds, lambda a, b: (a >= half) != (b >= half)), lambda x: x))).alias("runs"),
            F.aggregate(F.zip_with(firsts, seconds, lambda a, b: (a - centre) * (b - centre)), F.lit(0.0), lambda total, x: total + x).alias("product"))

    def spread(c: Column) -> Column:
        both = 2 * c["highs"] * (c["n"] - c["highs"])
        return F.struct(*[c[name].alias(name) for name in ("n", "size", "df", "chi", "runs", "product")], both.alias("both"))

    def tests(c: Column) -> Column:
        df, n, both, size = c["df"], c["n"], c["both"], c["size"]
        # Wilson and Hilferty's cube root
        p_chi = 1 - _once((F.pow(c["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)), _normal)
        variance = both * (both - n) / (n * n * (n - 1))
        p_runs = F.when(variance > 0, 2 * (1 - _once(F.abs(c["runs"] - (both / n + 1)) / F.sqrt(variance), _normal))).otherwise(0.0)
        # each product has mean 0 and the squared variance of the uniform
        p_serial = 2 * (1 - _once(F.abs(c["product"] / ((size * size - 1) / 12) / F.sqrt(n - 1)), _normal))

        def log(p: Column) -> Column:
            return F.log(F.greatest(p, F.lit(1e-12)))

        return -(log(p_chi) + log(p_runs) + log(p_serial))  # half of Fisher's statistic, six degrees of freedom

    x = _once(_once(_once(drawn, counted), spread), tests)
    return _once(x, lambda x: F.exp(-x) * (1 + x + x * x / 2))


def randomness(token: Column, name: Column) -> Column:
    """The battery's p-value under the inferred encoding; null without one."""
    alphabet = _of(name, {known: letters for known, (letters, _) in ALPHABETS.items()})
    cells = _of(name, {known: cells for known, (_, cells) in ALPHABETS.items()})
    drawn = _once(alphabet, lambda letters: F.struct(
        _codes(token, name, letters).alias("codes"), F.length(letters).alias("size"), cells.alias("cells")))
    return F.when(name.isNotNull(), _battery(drawn))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def stratum(token: Column) -> Column:
    """Length strata, two per doubling; the last one is open."""
    return F.least(F.floor(2 * F.log2(F.length(token) / float(LEAST))), F.lit(STRATA - 1)).cast("int")


def _candidates(text: Column) -> Column:
    """Candidate tokens with position, encoding and p-value."""
    found = F.transform(_spans(text, CANDIDATE, text.rlike(CANDIDATE)), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), encoding(s["match"]).alias("encoding")))
    found = F.filter(found, lambda s: s["encoding"].isNotNull())
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["encoding"].alias("encoding"), stratum(s["match"]).alias("stratum"),
        randomness(s["match"], s["encoding"]).alias("p")))


def cuts(documents: DataFrame, text_column: str = "text", false_share: float = FALSE_SHARE) -> dict[tuple[str, int], float]:
    """The p-value from which a token counts as a secret, by encoding and length stratum, over all documents."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    cells = (documents.select(F.explode(_candidates(text)).alias("c"))
             .select("c.encoding", "c.stratum", F.least(F.floor(F.col("c.p") * CELLS_OF_P), F.lit(CELLS_OF_P - 1)).cast("int").alias("cell"))
             .groupBy("encoding", "stratum", "cell").agg(F.count("*").alias("n")))
    tables: dict[tuple[str, int], list[int]] = {}
    for row in cells.collect():  # at most len(ALPHABETS) encodings, STRATA strata and CELLS_OF_P cells
        tables.setdefault((row.encoding, row.stratum), [0] * CELLS_OF_P)[row.cell] = row.n
    return {key: _cut(counts, false_share) for key, counts in tables.items()}


def _cut(counts: list[int], false_share: float) -> float:
    half = CELLS_OF_P // 2
    random = min(sum(counts), 2 * sum(counts[half:]))
    for cell in range(half + 1):
        kept = sum(counts[cell:])
        expected = random * (1 - cell / CELLS_OF_P)
        if kept - expected <= false_share * kept:
            return max(cell / CELLS_OF_P, 1e-3)
    return half / CELLS_OF_P


def secrets(text: Column, cut: dict[tuple[str, int], float]) -> Column:
    """array<struct<start, kind_no, end>> of all spans, by start and then kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def marked(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind_no"), s["end"].alias("end")))

    assign = _spans(text, ASSIGN, (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(ASSIGN))
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    access = _spans(text, ACCESS, F.contains(text, F.lit("AKIA")))
    base = F.concat(marked(assign, 0), marked(access, 1), marked(_spans(text, HEX, text.rlike(HEX)), 2))
    if not cut:
        return F.array_sort(base)
    limits = F.create_map(*[F.lit(x) for key, value in sorted(cut.items()) for x in (f"{key[0]}:{key[1]}", value)])
    likely = F.filter(_candidates(text), lambda c: c["p"] >= F.element_at(
        limits, F.concat(c["encoding"], F.lit(":"), c["stratum"].cast("string"))))

    def joined(both: Column) -> Column:
        every = F.array_sort(F.concat(both["base"], marked(both["likely"], 3)))
        return F.when((F.size(both["base"]) > 0) & (F.size(both["likely"]) > 0), _apart(every)).otherwise(every)

    return _once(F.struct(base.alias("base"), likely.alias("likely")), joined)


def _apart(spans: Column) -> Column:
    """The spans, sorted, without added ones that overlap a base one."""
    far = F.lit((1 << 31) - 1)

    def kept(found: Column) -> Column:
        base = F.transform(found, lambda s: F.when(s["kind_no"] < 3, s["end"]).otherwise(0))
        ahead = F.transform(F.reverse(found), lambda s: F.when(s["kind_no"] < 3, s["start"]).otherwise(far))
        bounds = F.struct(
            _scan(base, lambda v: F.coalesce(F.array_max(v), F.lit(0)), F.greatest).alias("before"),
            F.reverse(_scan(ahead, lambda v: F.coalesce(F.array_min(v), far), F.least)).alias("after"))
        return _once(bounds, lambda b: F.filter(found, lambda s, i: (s["kind_no"] < 3) | (
            (F.get(b["before"], i) <= s["start"]) & (F.get(b["after"], i) >= s["end"]))))

    return _once(spans, kept)


def named(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.filter(spans, lambda s: s["kind_no"] == number)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by the mark.

    The text is cut into pieces of ``PIECE`` code points once; what stays between spans is read
    from the pieces it touches.
    """
    def between(pieces: Column, start: Column, end: Column) -> Column:
        touched = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
        parts = F.transform(touched, lambda n: F.substring(
            F.get(pieces, n), F.greatest(start - n * PIECE, F.lit(0)) + 1,
            F.least(end - n * PIECE, F.lit(PIECE)) - F.greatest(start - n * PIECE, F.lit(0))))
        return F.when(end > start, F.array_join(parts, "")).otherwise("")

    def built(given: Column) -> Column:
        found, reached = given["spans"], given["reached"]
        kept = F.transform(found, lambda s, i: F.when(
            s["start"] >= F.when(i == 0, 0).otherwise(F.get(reached, i - 1)),
            F.concat(between(given["pieces"], F.when(i == 0, 0).otherwise(F.get(reached, i - 1)), s["start"]), F.lit(mark))).otherwise(""))
        last = F.get(reached, F.size(reached) - 1)
        return F.concat(F.array_join(kept, ""), between(given["pieces"], last, given["length"]))

    reached = _scan(F.transform(spans, lambda s: s["end"]), F.array_max, F.greatest)
    given = F.struct(spans.alias("spans"), reached.alias("reached"), F.length(text).alias("length"),
                     F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)).alias("pieces"))
    return F.when(F.size(spans) > 0, _once(given, built)).otherwise(text)


def with_spans(text: Column, spans: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(text, spans)`` with the spans computed once."""
    return _once(spans, lambda found: use(text, found))


def secret_scan(documents: DataFrame, text_column: str = "text", spans_column: str = "secrets") -> DataFrame:
    """The documents with their spans added as ``spans_column``."""
    return documents.withColumn(spans_column, secrets(F.col(text_column), cuts(documents, text_column)))
