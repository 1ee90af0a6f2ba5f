"""SentencePiece encoding and decoding with a relational lattice.

Texts are cut into units that no piece of the model crosses (``Units``; that pieces keep to the
marks is checked when a model is read).  The lattice is made of
DataFrames: the substrings of a unit, of bounded length, are exploded and joined to the piece
table; the edges are grouped by unit and folded with Spark's higher-order ``aggregate``.

The fold depends on the model.  For a unigram model it is Viterbi's: per position the best score
and the edge it came by.  A merge (BPE) model has no scores to add, its best path by sums is not
its segmentation; there the fold keeps the boundaries and goes through the edges from the highest
score (then from the left), applying each that spans exactly two neighbouring segments, which is
the model's own definition.

The lattice encodes the units that make up most of the corpus: those of at least some count over
all documents, the count chosen so that at most ``TABLE`` units are kept.  The encoded table has
that bound, so it is shipped to the tasks, where each text looks its units up; the rare rest is
encoded there by the same definition.  So no token travels, and nothing depends on the bound but
time.  Decoding joins bytes of pieces, which undoes encoding for every text without the piece
mark itself.

Defined results: null and empty texts have no ids; characters outside the model become byte
pieces (or the unknown piece); units of any length are encoded; repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import re
import string
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import record_batches, sliced
from tidewatch.session import materialise, share

MARK = "▁"
TABLE, LONGEST_UNIT = 1 << 18, 40
_SEEN, _KNOWN = 400_000, 100_000
_NEVER = float("-inf")
_NO_PIECE = (0, _NEVER)


@dataclass
class Model:
    kind: str  # "bpe" or "unigram"
    pieces: dict[str, tuple[int, float]]  # pieces that texts may hold: id and score
    texts: list[bytes]  # the bytes each id stands for
    bytes_from: int | None  # the id of the byte piece 0; None without byte pieces
    unknown: int
    dummy_prefix: bool = True

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @property
    def unknown_score(self) -> float:
        return min(score for _, score in self.pieces.values()) - 10


def read_model(path: str, kind: str = "bpe", dummy_prefix: bool = True) -> Model:
    """A model file, its kind given; text must be taken as it is (identity normalisation)."""
    import sentencepiece

    with open(path, "rb") as file:  # a file of the driver, a few hundred kilobytes
        processor = sentencepiece.SentencePieceProcessor(model_proto=file.read())
    pieces, texts, first_byte = {}, [], None
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            first_byte = i if first_byte is None else first_byte
            texts.append(bytes([i - first_byte]))
        elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
            texts.append(b"")
        else:
            pieces[piece] = i, processor.get_score(i)
            texts.append(piece.replace(MARK, " ").encode())
    crossing = [p for p in pieces if "\n" in p or MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces of this model cross units, such as {crossing[0]!r}")
    return Model(kind, pieces, texts, first_byte, processor.unk_id(), dummy_prefix)


class Units:
    """Cuts texts where no piece of a model can join: before marks, at line ends, and between a
    letter or digit and ASCII punctuation, unless some piece holds such a pair."""

    def __init__(self, model: Model):
        joined = {a + b for piece in model.pieces for a, b in zip(piece, piece[1:])}
        pairs = [p for p in joined if p[1] in string.punctuation and (p[0].isalnum() or p[0] == "_")]
        odd = re.escape("".join(sorted({p[0] for p in pairs if p[0] != "_" and not p[0].isascii()})))
        apart = set(string.punctuation) - {p[1] for p in pairs if p[0].isascii() and p[0] != "_"}
        letters = rf"[^\W_{odd}]"  # without the few that a piece does join to punctuation
        other, joining = rf"[_{odd}]|[^\w{MARK}\n]", rf"[^\w{MARK}\n{re.escape(''.join(sorted(apart)))}]"
        joining += (f"|[{odd}]" if odd else "") + ("" if "_" in apart else "|_")
        self.find = re.compile(
            rf"\n|(?=[^\n]){MARK}*(?:{other})*{letters}*(?:(?:{joining})(?:{other})*{letters}*)*").findall
        self.prefix = " " * model.dummy_prefix

    def __call__(self, text: str | None) -> list[str]:
        return self.find((self.prefix + text).replace(" ", MARK)) if text else []


class Encoder:
    """Unit to ids (as 32-bit bytes), for the units outside the table."""

    def __init__(self, model: Model):
        self.model, self.known = model, model.pieces.get

    def ids(self, segments: list[str]) -> bytes:
        out = []
        for segment in segments:
            known = self.model.pieces.get(segment)
            if known:
                out.append(known[0])
            elif self.model.bytes_from is None:
                out.append(self.model.unknown)
            else:
                out += [self.model.bytes_from + b for b in segment.encode()]
        return array("i", out).tobytes()

    def encode(self, unit: str) -> bytes:
        if self.model.kind != "bpe":
            return self.ids(self._best(unit))
        return self.ids(self._merged(unit) if len(unit) > LONGEST_UNIT else self._merged_short(unit))

    def _merged_short(self, unit: str) -> list[str]:
        """As ``_merged``, by scans: quicker for units of a few characters."""
        symbols, known = list(unit), self.known
        scores = [known(a + b, _NO_PIECE)[1] for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == _NEVER:
                break
            at = scores.index(best)
            symbols[at] += symbols.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = known(symbols[at - 1] + symbols[at], _NO_PIECE)[1]
            if at < len(scores):
                scores[at] = known(symbols[at] + symbols[at + 1], _NO_PIECE)[1]
        return symbols

    def _merged(self, unit: str) -> list[str]:
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(symbols):
                joined = symbols[left] + symbols[after[left]]
                if joined in self.model.pieces:
                    heapq.heappush(heap, (-self.model.pieces[joined][1], left, joined))

        for left in range(len(unit) - 1):
            offer(left)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            if symbols[left] is None or right >= len(symbols) or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(left)
            offer(before[left])
        return [s for s in symbols if s is not None]

    def _best(self, unit: str) -> list[str]:
        longest, unknown = self.model.longest, self.model.unknown_score
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(unit) + 1):
            ways = [(best[s][0] + self.model.pieces[unit[s:end]][1], s) for s in range(max(0, end - longest), end)
                    if unit[s:end] in self.model.pieces]
            if unit[end - 1:end] not in self.model.pieces:
                ways.append((best[end - 1][0] + unknown, end - 1))
            best.append(max(ways))
        segments, end = [], len(unit)
        while end:
            segments.append(unit[best[end][1]:end])
            end = best[end][1]
        return segments[::-1]


class Table(dict):
    """Unit to ids; what the table lacks is encoded and remembered within a bound."""

    def __init__(self, table: dict[str, bytes], model: Model):
        super().__init__(table)
        self.encoder, self.rare = Encoder(model), {}

    def __missing__(self, unit: str) -> bytes:
        found = self.rare.get(unit)
        if found is None:
            if len(self.rare) >= _KNOWN:
                self.rare.clear()
            found = self.rare[unit] = self.encoder.encode(unit)
        return found


def unit_counts(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """(unit, n) over all documents, of units short enough for the lattice."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, units = Counter(), Units(model)

        def flush():
            kept = [(unit, n) for unit, n in seen.items() if len(unit) <= LONGEST_UNIT]
            seen.clear()
            yield from record_batches(["unit", "n"], [pa.string(), pa.int64()], [[u for u, _ in kept], [n for _, n in kept]])

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(units(text))
                if len(seen) > _SEEN:
                    yield from flush()
        yield from flush()

    return (documents.select(F.col(text_column).cast("string")).mapInArrow(count, "unit string, n long")
            .groupBy("unit").agg(F.sum("n").alias("n")))


def frequent(counts: DataFrame, table: int = TABLE) -> DataFrame:
    """The units above the least count that keeps at most ``table`` of them (counts in steps of a quarter doubling)."""
    step = F.floor(4 * F.log2("n")).cast("int")
    total, least = 0, 1 << 30
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("units")).orderBy(F.desc("step")).collect():
        total += row.units  # at most 256 steps
        if total > table:
            break
        least = row.step
    return counts.where(step >= least).select("unit")


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """(unit, edges): per unit the pieces in it as (rank, start, length, score, id), best first."""
    session = units.sparkSession
    known = session.createDataFrame([(p, i, s) for p, (i, s) in model.pieces.items()], "piece string, id int, score double")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.length("unit") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(model.longest), F.length("unit") - s)),
        lambda n: F.struct(s.alias("start"), n.alias("length"), F.substring("unit", s + 1, n).alias("piece")))))
    edges = (units.select("unit", F.explode(spans).alias("span")).select("unit", "span.*")
             .join(F.broadcast(known), "piece")  # a vocabulary: its size is that of the model file
             .groupBy("unit").agg(F.sort_array(F.collect_list(F.struct(
                 (-F.col("score")).alias("rank"), "start", "length", "score", "id"))).alias("edges")))
    none = F.array().cast("array<struct<rank:double,start:int,length:int,score:double,id:int>>")
    return units.join(edges, "unit", "left").select("unit", F.coalesce("edges", none).alias("edges"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _merge_fold(edges: Column, size: Column) -> Column:
    """Segment boundaries of a merge model.

    Boundaries are bits of a number.  One pass over the edges is enough: a piece was learned after
    the two it joins, so when its turn comes those within it have been joined or never will be.
    """
    def step(bounds: Column, e: Column) -> Column:
        inner, ends = _bit(e["start"] + e["length"]) - _bit(e["start"] + 1), _bit(e["start"]) + _bit(e["start"] + e["length"])
        fits = (bounds.bitwiseAND(ends) == ends) & (F.bit_count(bounds.bitwiseAND(inner)) == 1)
        return F.when(fits, bounds - bounds.bitwiseAND(inner)).otherwise(bounds)

    bits = F.aggregate(edges, _bit(size + 1) - 1, step)
    return F.get(F.transform(F.array(bits), lambda bound: F.filter(
        F.sequence(F.lit(0), size), lambda i: bound.bitwiseAND(_bit(i)) != 0)), F.lit(0))


def _viterbi_fold(edges: Column, size: Column, unknown_score: float) -> Column:
    """Segment boundaries of the best path of a unigram model; a character without a piece is an edge of its own."""
    def step(best: Column, end: Column) -> Column:
        ending = F.transform(F.filter(edges, lambda e: e["start"] + e["length"] == end), lambda e: F.struct(
            (F.get(best, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("start")))
        single = F.exists(edges, lambda e: (e["start"] == end - 1) & (e["length"] == 1))
        skip = F.array(F.struct((F.get(best, end - 1)["score"] + F.lit(unknown_score)).alias("score"), (end - 1).alias("start")))
        return F.concat(best, F.array(F.array_max(F.when(single, ending).otherwise(F.concat(ending, skip)))))

    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start")))
    best = F.aggregate(F.sequence(F.lit(1), size), first, step)

    def back(bounds: Column, _: Column, paths: Column) -> Column:
        at = F.get(bounds, F.lit(0))
        return F.when(at == 0, bounds).otherwise(F.concat(F.array(F.get(paths, at)["start"]), bounds))

    return F.get(F.transform(F.array(best), lambda paths: F.aggregate(
        F.sequence(F.lit(1), size), F.array(size), lambda bounds, i: back(bounds, i, paths))), F.lit(0))


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) by the relational lattice."""
    size, edges = F.length("unit"), F.col("edges")
    bounds = _merge_fold(edges, size) if model.kind == "bpe" else _viterbi_fold(edges, size, model.unknown_score)

    def spelled(start: Column, end: Column) -> Column:
        """Byte pieces of a character without a piece, or the unknown piece."""
        if model.bytes_from is None:
            return F.array(F.lit(model.unknown))
        pairs = F.regexp_extract_all(F.hex(F.encode(F.substring("unit", start + 1, end - start), "UTF-8")), F.lit("(..)"), F.lit(1))
        return F.transform(pairs, lambda pair: F.conv(pair, 16, 10).cast("int") + model.bytes_from)

    def ids_of(b: Column, i: Column) -> Column:
        start, end = F.get(b, i), F.get(b, i + 1)
        found = F.filter(edges, lambda e: (e["start"] == start) & (e["length"] == end - start))
        return F.when(F.size(found) > 0, F.array(F.get(found, F.lit(0))["id"])).otherwise(spelled(start, end))

    ids = F.flatten(F.get(F.transform(F.array("bounds"), lambda b: F.transform(
        F.sequence(F.lit(0), F.size(b) - 2), lambda i: ids_of(b, i))), F.lit(0)))
    return lattice(units, model).withColumn("bounds", bounds).select("unit", ids.alias("ids"))


class Codec:
    """A model with its encoded table for one corpus; ``encode`` and ``decode`` are columns."""

    def __init__(self, documents: DataFrame, model: Model, text_column: str = "text", table: int = TABLE):
        units = frequent(materialise(unit_counts(documents, model, text_column), "unit-counts"), table)
        rows = encode_units(units, model).toArrow()  # at most ``table`` rows
        encoded = {u: np.array(ids, np.int32).tobytes()
                   for u, ids in zip(rows["unit"].to_pylist(), rows["ids"].to_pylist(), strict=True)}
        self.shared = share(documents.sparkSession, (encoded, model))

    def encode(self, text: Column) -> Column:
        shared, held = self.shared, []

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(texts):
            return _lists(*_encoded(_tools(shared, held), texts.to_pylist()))

        return encode(text.cast("string"))

    def decode(self, ids: Column) -> Column:
        shared = self.shared

        @F.arrow_udf(T.StringType())
        def decode(lists):
            import pyarrow as pa

            sizes = lists.value_lengths().fill_null(0).to_numpy()
            return pa.array(_decoded(shared.value[1], lists.flatten().to_numpy(zero_copy_only=False), sizes), pa.string())

        return decode(ids)

    def checked(self, text: Column) -> Column:
        """struct(ids, round_trip): the ids, and whether decoding them gives the text back."""
        shared, held = self.shared, []

        @F.arrow_udf(T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("round_trip", T.BooleanType()))
        def check(texts):
            import pyarrow as pa

            plain = texts.to_pylist()
            sizes, flat = _encoded(_tools(shared, held), plain)
            back = _decoded(shared.value[1], flat, sizes)
            same = [made == (text or "").replace(MARK, " ") for made, text in zip(back, plain, strict=True)]
            return pa.StructArray.from_arrays([_lists(sizes, flat), pa.array(same, pa.bool_())], ["ids", "round_trip"])

        return check(text.cast("string"))


def _tools(shared, held: list) -> tuple[Table, Units]:
    """The task's table and cutter, made once."""
    if not held:
        held.extend((Table(*shared.value), Units(shared.value[1])))
    return tuple(held)


def _encoded(tools: tuple[Table, Units], texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of the texts, and all ids in a row."""
    table, units = tools
    made = [b"".join(map(table.__getitem__, units(text))) for text in texts]
    return np.array([len(ids) // 4 for ids in made], np.int64), np.frombuffer(b"".join(made), np.int32)


def _decoded(model: Model, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
    piece, out, end = model.texts.__getitem__, [], 0
    for size in sizes.tolist():
        start, end = end, end + size
        made = b"".join(map(piece, flat[start:end].tolist()))
        out.append((made[1:] if model.dummy_prefix and made[:1] == b" " else made).decode("utf-8", "replace"))
    return out


def _lists(sizes: np.ndarray, flat: np.ndarray):
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoded(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_ids, ids, round_trip): whole texts as ids, and whether decoding gives the text back.

    A piece mark in a text is decoded as a space, as the model has one piece for both.
    """
    made = documents.select(id_column, Codec(documents, model, text_column).checked(F.col(text_column)).alias("made"))
    return made.select(id_column, F.size("made.ids").cast("long").alias("n_ids"), "made.ids", "made.round_trip")
