"""Packing of tokenised documents into sequences of a fixed window.

A document of n ids is n // window whole windows, each a sequence of its own, and a tail.  Tails
are packed by a plan made from their length histogram alone (at most ``window`` numbers):

1. Enumerate shallow combinations (one, two or three lengths) that fill the window or one of its
   halves, quarters, ... exactly; parts of a window are glued to whole windows afterwards.
2. Solve the repeat count of every combination by non-negative least squares against the
   histogram, round down, and never take more of a length than there is.
3. Pack the residual greedily, the longest first; what is still free in a window is filled by
   cutting a longer tail, whose rest goes back into the histogram.

The plan is a table of rank intervals: of the tails of one length, those ranked lo to hi go into
consecutive windows.  So a tail finds its places from its rank among the tails of its length, and
a rank is a task's offset plus the place within the task.  No document leaves its task for that.
Sequences are full, but for a few at the very end whose length is a power of two.

Documents are encoded once and written.  White space separates pre-tokens in the supported
tokenizers and is dropped, so a text is cut at ASCII white space and each distinct unit of a batch
is encoded once, many units in one call with a mark between them; texts that may hold a special
token are encoded whole.  Units of Latin letters, perhaps with a final stop or comma, skip the
normaliser and go to the model at once, if the tokenizer gives the probes the same ids so.

Defined results: a null or empty text has only the end id; null ids and repeated rows are packed
row by row; very long texts are encoded whole, one row at a time; an empty table gives no rows;
columns besides id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import binary_values, sliced
from tidewatch.session import materialise, share, ship_package

WINDOW = 4_096
END_ID = 2
#: Lengths that triples are made of (their third length is free); smallest part of a window.
FREQUENT, SMALLEST = 64, 64
STEPS = 400            # of the least-squares iteration
REMEMBERED = 1 << 19   # units whose ids a task remembers from batch to batch
JOINED = 2_000         # units encoded in one call
OFFSET_ROWS = 250_000  # most offsets that are broadcast, about 6 MB
MARK = b"\x01"
#: Letters whose composed form, lower case and class every Unicode version agrees on, and what may end a word of them.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_STOPS = b".,;:!?"
_PROBES = ["a", "word", "été", "straße", "ñandú", "Über", "zqxjk" * 5, "thequickbrownfox", "ÿþð"]
_ENCODED = "doc_id long, ids binary, tail int, part int, place long, windows_before long"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# -- encoding ------------------------------------------------------------------------


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def id_type(path: str, end_id: int) -> str:
    """The numpy type ids are stored as: two bytes where all of them fit."""
    return "<u2" if max(_tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


class _Numbers(dict):
    """Numbers of units in order of their first look-up; ``new`` lists those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, unit: bytes) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number


class Encoder:
    """Ids of whole texts; the ids of units between white space are remembered."""

    def __init__(self, path: str) -> None:
        self.model = _tokenizer(path)
        self.special = [token.content.encode().lower() for token in self.model.get_added_tokens_decoder().values()]
        mark = self._whole(MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.direct, self.bytes_of = self._direct()
        stops = {stop: self._whole(bytes([stop])) for stop in _STOPS}
        self.stops = {stop: int(ids[0]) for stop, ids in stops.items() if len(ids) == 1}
        self._forget()

    def _direct(self):
        """The bare model on words of letters written as its byte symbols, or None where that differs."""
        from tokenizers import Tokenizer, pre_tokenizers

        symbols = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {ord(c): symbols.pre_tokenize_str(c)[0][0] for c in map(chr, [1, *range(0xDF, 0x100)])}
        bare = Tokenizer(self.model.model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probes = [*_PROBES, MARK.decode()]
        found = bare.encode_batch([word.lower().translate(table) for word in probes], add_special_tokens=False)
        same = all(row.ids == self._whole(word.encode()).tolist() for row, word in zip(found, probes))
        return (bare if same else None), table

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.starts = self.lengths = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.model.encode(text.decode(), add_special_tokens=False).ids, np.int32)

    def _joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of the units by the whole tokenizer."""
        return self._grouped(self.model, [unit.decode() for unit in units], MARK.decode(), units)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words of letters by the bare model."""
        written = [word if word.isascii() else word.lower().translate(self.bytes_of) for word in words]
        return self._grouped(self.direct, written, MARK.decode().translate(self.bytes_of), words)

    def _grouped(self, model, texts: list[str], mark: str, units: list) -> tuple[np.ndarray, np.ndarray]:
        """Many units in one text; the mark's own id stands between them."""
        groups = [slice(at, at + JOINED) for at in range(0, len(texts), JOINED)]
        rows, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for group, encoding in zip(groups, model.encode_batch_fast([f" {mark} ".join(texts[g]) for g in groups], add_special_tokens=False)):
            ids = np.array(encoding.ids, np.int32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(texts[group]) - 1:
                rows.append(np.delete(ids, marks))
                sizes.append(np.diff(marks, prepend=-1, append=len(ids)) - 1)
            else:  # a unit holds the mark: one by one
                alone = [self._whole(unit) for unit in units[group]]
                rows += alone
                sizes.append(np.array([len(row) for row in alone]))
        return np.concatenate(rows), np.concatenate(sizes)

    def _letters_only(self, unit: bytes) -> bool:
        return unit.isalpha() or not unit.isascii() and _LETTERS.fullmatch(unit.decode()) is not None

    def _learn(self) -> None:
        """Encode the new units.  A unit of letters and one stop is the letters, then the stop."""
        first, new = len(self.starts), self.numbers.new
        other, plain, stopped = ([], []), ([], []), ([], [], [])
        for place, unit in enumerate(new):  # grows by the letters of units with a stop
            if self.direct and unit[-1] in self.stops and self._letters_only(unit[:-1]):
                for values, value in zip(stopped, (place, self.numbers[unit[:-1]], self.stops[unit[-1]])):
                    values.append(value)
            else:
                places, units = plain if self.direct and self._letters_only(unit) else other
                places.append(place)
                units.append(unit)
        self.starts, self.lengths = (np.concatenate([old, np.zeros(len(new), np.int64)]) for old in (self.starts, self.lengths))
        self._add(first + np.array(other[0], np.int64), *self._joined(other[1]))
        self._add(first + np.array(plain[0], np.int64), *self._letters([word.decode() for word in plain[1]]))
        if stopped[0]:
            cores = np.array(stopped[1])
            self._add(first + np.array(stopped[0]), np.insert(self._ids(cores), np.cumsum(self.lengths[cores]), stopped[2]), self.lengths[cores] + 1)
        new.clear()

    def _add(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts[numbers] = len(self.pool) + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.pool = np.concatenate([self.pool, ids.astype(np.int32, copy=False)])

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of every text, without an end id."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        found: list[np.ndarray] = []
        for text in texts:
            low = text.lower() if text else b""
            if low and (self.mark is None or any(token in low for token in self.special)):
                found.append(self._whole(text))
            else:
                words = low.split()
                found.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self._learn()
        return [row if row.dtype == np.int32 else self._ids(row) for row in found]

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of numbered units in a row."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        shift = self.starts[numbers] - (ends - lengths)
        return self.pool[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def encode(documents: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its ids with the end id, the length of its tail, and its place among
    the tails of that length, and among the whole windows, of its task (``part``)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, kind, part, seen, windows = Encoder(path), id_type(path, end_id), TaskContext.get().partitionId(), Counter(), 0
        for batch in sliced(batches):
            stored, tails, places, before = [], [], [], []
            for row in encoder.encode(binary_values(batch.column(1))):
                length = len(row) + 1
                tail = length % window
                stored.append(np.append(row, np.int32(end_id)).astype(kind).tobytes())
                tails.append(tail)
                places.append(seen[tail])
                before.append(windows)
                seen[tail] += 1
                windows += length // window
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(stored, pa.binary()), pa.array(tails, pa.int32()), pa.array([part] * len(tails), pa.int32()),
                 pa.array(places, pa.int64()), pa.array(before, pa.int64())],
                ["doc_id", "ids", "tail", "part", "place", "windows_before"])

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, _ENCODED)


# -- the plan ------------------------------------------------------------------------


def combinations(counts: np.ndarray, window: int = WINDOW, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(target, lengths x 3 padded with 0) of combinations of one, two or three occurring lengths
    that fill a target exactly.  Targets are the window and its halves down to ``SMALLEST``."""
    there = counts > 0
    there[0] = False
    lengths = np.flatnonzero(there)
    common = lengths[np.argsort(-counts[lengths], kind="stable")[:frequent]]
    targets, rows = [], []
    target = window
    while target >= min(SMALLEST, window):
        found = [np.zeros((0, 3), np.int64)]
        if target < len(there) and there[target]:
            found.append(np.array([[target, 0, 0]]))
        small = lengths[2 * lengths <= target]
        pairs = small[there[np.minimum(target - small, len(there) - 1)] & (target - small < len(there))]
        found.append(np.stack([pairs, target - pairs, np.zeros_like(pairs)], axis=1))
        a, b = (x.ravel() for x in np.meshgrid(common, common))
        c = target - a - b
        fits = (a <= b) & (c >= 1) & (c < len(there))
        a, b, c = a[fits], b[fits], c[fits]
        triples = np.sort(np.stack([a, b, c], axis=1)[there[c]], axis=1)
        found.append(np.unique(triples, axis=0))
        rows.append(np.concatenate(found))
        targets.append(np.full(len(rows[-1]), target))
        target //= 2
    return np.concatenate(targets), np.concatenate(rows)


def non_negative_least_squares(lengths: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used nearest to their counts.

    Multiplicative updates x <- x * (A'h) / (A'Ax): for non-negative A and h they never leave
    x >= 0 and the squared error falls in each step.  A is kept as the index table ``lengths``.
    """
    h = counts.astype(np.float64).copy()
    h[0] = 0.0
    used = lengths > 0
    goal = (h[lengths] * used).sum(axis=1)
    x = h[lengths].min(axis=1, initial=np.inf, where=used) / 2
    for _ in range(steps if len(x) else 0):
        made = np.bincount(lengths.ravel(), (x[:, None] * used).ravel(), minlength=len(h))
        made[0] = 0.0
        x = x * goal / np.maximum((made[lengths] * used).sum(axis=1), 1e-12)
    return x


class Plan:
    """Rank intervals: ``rows[tail]`` holds (lo, hi, start, length, target, first window, offset).

    The tail ranked r in [lo, hi) has a piece from ``start`` on in window ``first + r - lo`` of
    size ``target``; ``sequence`` tells which sequence that window is part of, and where.
    """

    def __init__(self, counts: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        self.rows: dict[int, list[tuple]] = {}
        self.windows: Counter = Counter()
        self.free = {int(n): deque([(int(n), 0, int(c), 0)]) for n, c in enumerate(counts) if n and c}
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.cuts = 0
        self._combine()
        self._pack_residual()
        self._number()

    def _take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """``n`` tails of a length as (root length, lowest rank, how many, start within the tail)."""
        self.left[length] -= n
        taken, queue = [], self.free[length]
        while n:
            root, rank, there, start = queue.popleft()
            used = min(there, n)
            taken.append((root, rank, used, start))
            if there > used:
                queue.appendleft((root, rank + used, there - used, start))
            n -= used
        return taken

    def _place(self, taken: list[tuple], length: int, target: int, first: int, offset: int) -> None:
        for root, rank, n, start in taken:
            self.rows.setdefault(root, []).append((rank, rank + n, start, length, target, first, offset))
            first += n

    def _windows(self, target: int, n: int) -> int:
        first = self.windows[target]
        self.windows[target] += n
        return first

    def _combine(self) -> None:
        targets, lengths = combinations(self.left, self.window)
        wished = non_negative_least_squares(lengths, self.left)
        for number in np.argsort(-wished, kind="stable"):
            need = Counter(int(n) for n in lengths[number] if n)
            n = min([int(wished[number]), *(self.left[length] // times for length, times in need.items())])
            if n < 1:
                continue
            target, offset = int(targets[number]), 0
            first = self._windows(target, int(n))
            for length in lengths[number]:
                if length:
                    self._place(self._take(int(length), int(n)), int(length), target, first, offset)
                    offset += int(length)

    def _pack_residual(self) -> None:
        while True:
            total = int((self.left * np.arange(len(self.left))).sum())
            if not total:
                return
            target = self.window
            while target > total:
                target //= 2
            need, gap = Counter(), target
            fitting = np.flatnonzero(self.left[:gap + 1])
            for length in fitting[::-1]:
                times = min(gap // int(length), int(self.left[length]))
                if times:
                    need[int(length)] = times
                    gap -= times * int(length)
                if not gap:
                    break
            wanted, cut = need.copy(), 0
            if gap:
                cut = max(int(n) for n in np.flatnonzero(self.left) if n > gap and self.left[n] > need[int(n)])
                wanted[cut] += 1
            repeats = min(total // target, *(int(self.left[n]) // times for n, times in wanted.items()))
            first, offset = self._windows(target, repeats), 0
            for length, times in need.items():
                for _ in range(times):
                    self._place(self._take(length, repeats), length, target, first, offset)
                    offset += length
            if cut:
                self.cuts += repeats
                taken = self._take(cut, repeats)
                self._place(taken, gap, target, first, offset)
                rest = cut - gap
                self.free.setdefault(rest, deque()).extend((root, rank, n, start + gap) for root, rank, n, start in taken)
                self.left[rest] += repeats

    def _number(self) -> None:
        """Sequences in order of target; windows that make up no whole sequence stay alone."""
        self.first_sequence, self.glued, next_sequence = {}, {}, 0
        for target in sorted(self.windows, reverse=True):
            per = self.window // target
            self.first_sequence[target] = next_sequence
            self.glued[target] = self.windows[target] // per
            next_sequence += self.glued[target] + self.windows[target] % per
        self.sequences = next_sequence
        self.tables = {tail: np.array(rows, np.int64) for tail, rows in self.rows.items()}

    def sequence(self, target: int, number: int) -> tuple[int, int]:
        """(sequence, offset) of a window of size ``target``."""
        per, whole = self.window // target, self.glued[target]
        if number < whole * per:
            return self.first_sequence[target] + number // per, number % per * target
        return self.first_sequence[target] + whole + number - whole * per, 0

    def pieces(self, tail: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of the tail with that rank, by start."""
        table = self.tables[tail]
        found = []
        for lo, _, start, length, target, first, offset in table[(table[:, 0] <= rank) & (rank < table[:, 1])].tolist():
            sequence, base = self.sequence(target, first + rank - lo)
            found.append((start, length, sequence, base + offset))
        return sorted(found)


# -- packing ------------------------------------------------------------------------


def _offsets(encoded: DataFrame, window: int, id_bytes: int) -> DataFrame:
    """(tail, part, first, total): how many tails of that length earlier tasks hold, and all tasks.

    Tail 0 stands for whole windows.  One row per task and length that occurs in it.
    """
    tails = encoded.where("tail > 0").groupBy("tail", "part").agg(F.count(F.lit(1)).alias("n"))
    windows = F.floor(F.octet_length("ids") / (id_bytes * window))
    whole = encoded.groupBy(F.lit(0).alias("tail"), "part").agg(F.sum(windows).alias("n"))
    earlier = W.partitionBy("tail").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("tail")
    return tails.union(whole).select("tail", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
                                     F.sum("n").over(every).alias("total"))


def pack(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID,
         id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece, and its ``ids``.

    Whole windows take the sequences after those of the plan.  ``ids_crc32`` is over the ids as
    unsigned little-endian 32-bit numbers.
    """
    spark = documents.sparkSession
    ship_package(spark)
    kind = np.dtype(id_type(path, end_id))
    encoded = materialise(encode(documents, path, end_id, window, id_column, text_column), "encoded")
    offsets = materialise(_offsets(encoded, window, kind.itemsize), "offsets")
    counts = np.zeros(window, np.int64)
    for tail, total in offsets.where("tail > 0").select("tail", "total").distinct().collect():
        counts[tail] = total
    plan = share(spark, Plan(counts, window))
    small = offsets.count() <= OFFSET_ROWS
    tails = offsets.where("tail > 0").select("tail", "part", F.col("first").alias("tail_first"))
    whole = offsets.where("tail = 0").select("part", F.col("first").alias("whole_first"))
    if small:
        tails, whole = F.broadcast(tails), F.broadcast(whole)
    placed = encoded.join(tails, ["tail", "part"], "left").join(whole, "part").select(
        "doc_id", "ids", "tail", (F.col("tail_first") + F.col("place")).alias("rank"),
        (F.col("whole_first") + F.col("windows_before")).alias("whole"))

    def run(batches: Iterator) -> Iterator:
        for batch in sliced(batches):
            yield _pieces(batch, plan.value, window, kind, with_ids)

    return placed.mapInArrow(run, _PIECE + (", ids array<int>" if with_ids else ""))


def _pieces(batch, plan: Plan, window: int, kind: np.dtype, with_ids: bool):
    import pyarrow as pa

    columns: list[list] = [[] for _ in range(7)]
    pieces = []
    for doc, stored, tail, rank, whole in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "tail", "rank", "whole"))):
        own = np.frombuffer(stored, kind)
        full = len(own) // window
        places = [(i * window, window, plan.sequences + whole + i, 0) for i in range(full)]
        if tail:
            places += [(full * window + start, length, sequence, offset) for start, length, sequence, offset in plan.pieces(tail, rank)]
        for start, length, sequence, offset in places:
            piece = own[start:start + length].astype("<u4")
            if with_ids:
                pieces.append(piece)
            for values, value in zip(columns, (doc, start, length, zlib.crc32(piece), len(own), sequence, offset)):
                values.append(value)
    arrays = [pa.array(values, pa.int64()) for values in columns]
    names = [column.split()[0] for column in _PIECE.split(", ")]
    if with_ids:
        bounds = pa.array(np.cumsum([0, *map(len, pieces)]), pa.int32())
        arrays.append(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.empty(0, np.uint32), *pieces]).astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)
