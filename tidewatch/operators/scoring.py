"""Cosine scores of arrivals or corpus points against interests.

A small registry is one block, shipped to every executor; vectors are then not shuffled.  A larger
one is dealt into as many blocks as the session runs tasks, and the vectors stream past each of
them: in order of arrival, so that a strategy meets all events in one task and hands on only what
may still rank.  If blocks must be smaller than that, a task holds a bounded part of the vectors
instead and all blocks stream past it, one at a time.  Shuffled are the vectors once per task, or
the registry once per part; no registry row passes through the driver but those of a small one.

Strategies with the same filters are a class.  A class meets only the vectors that pass its filters,
in matrix products of single precision; whatever may reach the strategy's k-th best score so far
within the error bound of that product is scored again in double precision.

Null list elements match nothing, as in SQL.  Vectors of another length than most query
vectors take no part; ``misfits`` names them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import SEARCH_LIMIT
from tidewatch.session import materialise, share

BLOCK_BYTES = 128 << 20   # largest block of a registry in a task
SHIPPED_BYTES = 4 << 20   # largest registry shipped to executors beside a table of vectors
VECTOR_BYTES = 64 << 20   # vectors of a part that all registry blocks stream past
CELLS = 1 << 20           # scores in a matrix product
TILE_ROWS = 2048          # most vectors in a matrix product
FIRST_ROWS = 32           # vectors in the first product, before any score is known
KINDS = 1 << 25           # largest table of event kinds and strategy classes
FEW = 8                   # smaller groups of strategies share a product
EMITTED = 1 << 17         # rows collected before they are handed on
PACK_BYTES = 1 << 20      # vectors and their columns that travel as one row
PART_ROWS = 8192          # vectors of packs that are scored together
FOUND = "strategy_id string, point_id string, score double"
PAIR = "strategy_id string, event_id string, score double"
SCORED = "strategy_id string, event_id string, ingested_at timestamp, score double"


@dataclass(frozen=True)
class InterestBlock:
    """A size-checked registry as arrays, strategies in order of class: unit query vectors and filter
    look-ups of the classes.  Those of class c are ``bounds[c]`` up to ``bounds[c + 1]``."""

    ids: pa.Array
    thresholds: np.ndarray
    units: np.ndarray
    buckets: np.ndarray | None
    bounds: np.ndarray
    any_source: np.ndarray
    any_ticker: np.ndarray
    by_source: dict[str, np.ndarray]
    by_ticker: dict[str, np.ndarray]

    @cached_property
    def narrow(self) -> np.ndarray:
        return self.units.astype(np.float32)

    @cached_property
    def classes(self) -> np.ndarray:
        """The class of every strategy."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def mask(self, source: str | None, tickers: tuple[str, ...]) -> np.ndarray:
        """The classes that an event of that source and those tickers passes."""
        by_source, by_ticker = self.any_source.copy(), self.any_ticker.copy()
        if source in self.by_source:
            by_source[self.by_source[source]] = True
        for ticker in tickers:
            if ticker in self.by_ticker:
                by_ticker[self.by_ticker[ticker]] = True
        return by_source & by_ticker


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)


def _round6(scores: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores) + 0.0


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def _look_up(lists: list[frozenset | None]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    rows: dict[str, list[int]] = {}
    for row, values in enumerate(lists):
        for value in values or ():
            rows.setdefault(value, []).append(row)
    return np.array([v is None for v in lists], dtype=bool), {v: np.array(r) for v, r in rows.items()}


def misfits(frame: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector is not null and has another length: they take no part in scoring."""
    return frame.where(F.size(vector) != dim)


def _list_keys(lists: pa.Array) -> list[bytes]:
    """What tells lists of a column apart: the codes of their values; nothing for an empty or null one."""
    codes = pc.fill_null(lists.flatten().dictionary_encode().indices, -1).to_numpy().astype(np.int32).tobytes()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = np.cumsum(lengths, dtype=np.int64)
    return [codes[4 * start:4 * end] for start, end in zip((ends - lengths).tolist(), ends.tolist())]


def _sets(lists: pa.Array) -> list[frozenset | None]:
    """Lists as sets without nulls, None where nothing is listed; equal lists are one set."""
    keys = _list_keys(lists)
    first: dict[bytes, int] = {}
    for place, key in enumerate(keys):
        first.setdefault(key, place)
    made = {key: frozenset(lists[place].as_py()) - {None} if key else None for key, place in first.items()}
    return [made[key] for key in keys]


def _block_of(table: pa.Table) -> InterestBlock:
    keys = list(zip(*(_sets(table[name].combine_chunks()) for name in ("wanted_sources", "wanted_tickers"))))
    number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
    classes = np.array([number[key] for key in keys], dtype=np.int64)
    order = np.argsort(classes, kind="stable")
    any_source, by_source = _look_up([sources for sources, _ in number])
    any_ticker, by_ticker = _look_up([tickers for _, tickers in number])
    return InterestBlock(
        ids=table["strategy_id"].cast(pa.string()).combine_chunks().take(pa.array(order)),
        thresholds=table["threshold"].to_numpy()[order],
        units=_unit_rows(_matrix(table["query_vector"]))[order],
        buckets=_matrix(table["buckets"])[order] if "buckets" in table.column_names else None,
        bounds=np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=len(number)))]).astype(np.int64),
        any_source=any_source,
        any_ticker=any_ticker,
        by_source=by_source,
        by_ticker=by_ticker,
    )


@dataclass(frozen=True)
class Part:
    """Vectors to score: their rows, the kind (source, tickers) of each row and unit vectors."""

    rows: pa.Table
    codes: np.ndarray
    kinds: list[tuple]
    units: np.ndarray
    narrow: np.ndarray

    @cached_property
    def used(self) -> tuple[np.ndarray, np.ndarray]:
        """The kinds that occur, and which of them a row is."""
        return np.unique(self.codes, return_inverse=True)

    @cached_property
    def places(self) -> np.ndarray:
        """Where a row stands in the order of the point ids."""
        names = self.rows["point_id"].combine_chunks()
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        return place


def _part_of(rows: pa.Table) -> Part:
    sources, tickers = (rows[name].combine_chunks() for name in ("source", "tickers"))
    source = pc.fill_null(sources.dictionary_encode().indices, -1).to_numpy()
    keys = zip(source.tolist(), _list_keys(tickers))
    index: dict[tuple, int] = {}
    codes = np.array([index.setdefault(key, len(index)) for key in keys], dtype=np.int64)
    first = pa.array(np.unique(codes, return_index=True)[1])
    kinds = list(zip(sources.take(first).to_pylist(), (tuple(t or ()) for t in tickers.take(first).to_pylist())))
    units = _unit_rows(_matrix(rows["vector"]))
    return Part(rows, codes, kinds, units, units.astype(np.float32))


class Registry(NamedTuple):
    """The registry as scored: written once, with the usual length of its vectors, its bytes and its largest row's."""

    rows: DataFrame
    dim: int
    bytes: int
    row: int


def measured(interests: DataFrame | Registry, *extra: str) -> Registry:
    if isinstance(interests, Registry):
        return interests
    listed = F.coalesce(F.size("wanted_sources"), F.lit(0)) + F.coalesce(F.size("wanted_tickers"), F.lit(0))
    columns = ["strategy_id", "wanted_sources", "wanted_tickers", "threshold", "query_vector", *extra]
    stored = materialise(interests.where("query_vector is not null").select(*columns), "registry")
    dim = F.size("query_vector")
    size = dim * 8 + listed * 64 + 128
    usual = stored.groupBy(dim.alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.max(size).alias("row"))
    found = usual.orderBy(F.col("n").desc(), "dim").first()
    if found is None:
        return Registry(stored, 0, 0, 0)
    return Registry(stored.where(dim == found.dim), found.dim, found.bytes, found.row)


_Score = Callable[[InterestBlock, Iterable[Part]], Iterator[pa.RecordBatch]]


def _over_blocks(vectors: DataFrame, interests: DataFrame | Registry, max_bytes: int, schema: str, score: _Score,
                 order: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> DataFrame:
    """``score`` of the vectors against the registry; ``order`` is that of the vectors in a task where
    they are dealt to blocks, ``extra`` names further columns of the registry."""
    registry, dim, size, row = measured(interests, *extra)
    usable = vectors.where(F.coalesce(F.size("vector"), F.lit(0)) == dim)
    largest = max(max_bytes, row)
    if size <= (largest if vectors.isStreaming else min(largest, SHIPPED_BYTES)):
        shared = share(vectors.sparkSession, _block_of(registry.toArrow()))
        return usable.mapInArrow(lambda batches: score(shared.value, _parts(batches)), schema)
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = -(-size // largest)
    if blocks <= parallel:
        return _dealt_blocks(usable, registry, parallel, 1 if order else _parts_for(parallel, blocks), schema, score, order)
    return _held_parts(usable, registry, dim, largest, schema, score, order)


def _deal(name: str, into: int):
    return F.pmod(F.xxhash64(name), F.lit(into)).cast("int")


def _copies(into: int):
    return F.explode(F.sequence(F.lit(0), F.lit(into - 1)))


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both, with empty lists for null ones: to the filters they are the same, and a batch
    of Arrow rows takes time by the square of its null lists."""
    met = left.unionByName(right, allowMissingColumns=True)
    lists = [field for field in met.schema.fields if field.dataType.typeName() == "array"]
    return met.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in lists})


def _parts_for(tasks: int, blocks: int) -> int:
    """Into how many parts vectors are dealt that need no order: with as many parts as blocks both sides
    are copied least, but there must be at least ``blocks`` blocks."""
    return max(n for n in range(1, tasks + 1) if n == 1 or n * n <= tasks and n * blocks <= tasks)


def _dealt_blocks(vectors: DataFrame, registry: DataFrame, tasks: int, parts: int, schema: str, score: _Score, order: tuple[str, ...]) -> DataFrame:
    """Every registry block and part of the vectors in a task of its own, past which the vectors stream in their order.

    Strategies are dealt by a hash of their ids, so blocks hold about their share whatever the
    filters are.  Vectors are copied once per block; those that need no order are packed before.
    """
    blocks = tasks // parts
    left = registry.withColumns({"_task": _copies(parts), "_side": F.lit(0)}).withColumn(
        "_task", _deal("strategy_id", blocks) * parts + F.col("_task"))
    right = (vectors.withColumn("_part", F.lit(0)) if order else _packed(vectors, parts)).withColumns(
        {"_side": F.lit(1), "_task": _copies(blocks)}).withColumn("_task", F.col("_task") * parts + F.col("_part")).drop("_part")
    met = _side_by_side(left, right).repartitionById(tasks, F.col("_task"))
    rows = _parts if order else lambda batches: _parts(_unpacked(batches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            wanted = int((batch["_side"].to_numpy() == 0).sum())
            if wanted:
                held.append(batch.slice(0, wanted))
            if held and wanted < batch.num_rows:
                block = _block_of(pa.Table.from_batches(held))
                yield from score(block, rows(chain([batch.slice(wanted)], batches)))

    return met.sortWithinPartitions("_side", *order).mapInArrow(run, schema)


def _packed(vectors: DataFrame, parts: int) -> DataFrame:
    """(_part, packed): rows as Arrow messages of about ``PACK_BYTES``, dealt to parts by a hash of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(parts)], [0] * parts
        for batch in _sized(batches):
            for part in range(parts):
                mine = batch.filter(pc.equal(batch["_part"], part)).drop_columns(["_part"])
                held[part].append(mine)
                size[part] += mine.nbytes
                if size[part] >= PACK_BYTES:
                    yield _pack(part, held[part])
                    held[part], size[part] = [], 0
        for part in range(parts):
            if size[part]:
                yield _pack(part, held[part])

    return vectors.withColumn("_part", _deal(vectors.columns[0], parts)).mapInArrow(run, "_part int, packed binary")


def _pack(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([_message(pa.concat_batches(held))], pa.binary())], ["_part", "packed"])


def _sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PACK_BYTES``; a single row is never cut."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * PACK_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            held.append(batch.slice(start, step))
            size += held[-1].nbytes
            if size >= PACK_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _message(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packs, in batches of at least ``PART_ROWS`` but the last."""
    held, size = [], 0
    for batch in batches:
        for message in batch["packed"]:
            held += pa.ipc.open_stream(message.as_buffer())
            size += held[-1].num_rows
            if size >= PART_ROWS:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _held_parts(vectors: DataFrame, registry: DataFrame, dim: int, largest: int, schema: str, score: _Score, order: tuple[str, ...]) -> DataFrame:
    """Every part of the vectors in a task that holds it, past which all registry blocks stream.

    Vectors are dealt by a hash of their ids, so parts hold about their share whatever the keys are.  They
    are shuffled once, and registry rows once per part.  Blocks are cut from the registry in order of its
    filters: what a block wants of a part is then picked once for many strategies.
    """
    stored = materialise(vectors, "vectors")
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-stored.count() * dim * 8 // VECTOR_BYTES))
    left = stored.withColumns({"_task": _deal(stored.columns[0], parts), "_side": F.lit(0), "_like": F.lit(0).cast("bigint")})
    right = registry.withColumns({"_side": F.lit(1), "_like": F.xxhash64("wanted_sources", "wanted_tickers"), "_task": _copies(parts)})
    met, columns = _side_by_side(left, right).repartitionById(parts, F.col("_task")), stored.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], None
        for batch in batches:
            own = int((batch["_side"].to_numpy() == 0).sum())
            if own:
                held.append(batch.slice(0, own))
            if own < batch.num_rows:
                first = batch.slice(own)
                break
        if not held or first is None:
            return
        part = list(_parts([pa.Table.from_batches(held).select(columns).combine_chunks().to_batches()[0]]))
        held.clear()
        for block in _cut(chain([first], batches), dim, largest):
            yield from score(_block_of(block), part)

    return met.sortWithinPartitions("_side", "_like", *order).mapInArrow(run, schema)


def _cut(batches: Iterable[pa.RecordBatch], dim: int, largest: int) -> Iterator[pa.Table]:
    """Registry rows in blocks of at most that many bytes, as ``measured`` counts them, or of a single row."""
    held, size = [], 0
    for batch in batches:
        listed = sum(pc.fill_null(pc.list_value_length(batch[name]), 0).to_numpy().astype(np.int64) for name in ("wanted_sources", "wanted_tickers"))
        ends = np.concatenate([[0], np.cumsum(dim * 8 + listed * 64 + 128)])
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(ends, ends[start] + largest - size, side="right")) - 1
            end = max(end, start if held else start + 1)
            if end > start:
                held.append(batch.slice(start, end - start))
                size += ends[end] - ends[start]
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = end
    if held:
        yield pa.Table.from_batches(held)


class _Best:
    """The k best scores per strategy so far; column 0 is the k-th best.  ``seen`` counts vectors."""

    def __init__(self, thresholds: np.ndarray, k: int) -> None:
        self.k, self.thresholds, self.seen = k, thresholds, 0
        self.top = np.full((len(thresholds), k), -np.inf)

    def floor(self, strategies: np.ndarray) -> np.ndarray:
        """What a score must reach to be among the k best, or pass."""
        return np.maximum(self.top[strategies, 0], self.thresholds[strategies])

    def add(self, strategies: np.ndarray, scores: np.ndarray) -> None:
        """Scores of strategies, those of one strategy side by side."""
        starts = np.flatnonzero(np.concatenate([[True], strategies[1:] != strategies[:-1]])) if len(strategies) else []
        if not len(starts):
            return
        counts = np.diff(np.append(starts, len(strategies)))
        touched = strategies[starts]
        merged = np.full((len(touched), self.k + counts.max()), -np.inf)
        merged[:, :self.k] = self.top[touched]
        place = np.arange(len(strategies)) - np.repeat(starts, counts)
        merged[np.repeat(np.arange(len(touched)), counts), self.k + place] = scores
        self.top[touched] = np.partition(merged, -self.k, axis=1)[:, -self.k:]


class _All(_Best):
    """Nothing is outranked: every pair is wanted."""

    def __init__(self, strategies: int) -> None:
        super().__init__(np.full(strategies, -np.inf), 1)
        self.seen = TILE_ROWS

    def add(self, strategies: np.ndarray, scores: np.ndarray) -> None:
        pass


def _groups(block: InterestBlock, part: Part, rows: np.ndarray) -> Iterator[tuple]:
    """(strategies, the rows that some of them wants, and which rows x strategies if not all of them).

    Classes that want the same kinds of these rows go together; small groups share a product.
    """
    used, local = part.used if len(rows) == len(part.codes) else np.unique(part.codes[rows], return_inverse=True)
    allowed = np.stack([block.mask(*part.kinds[kind]) for kind in used])
    alike: dict[bytes, list[int]] = {}
    for number in range(allowed.shape[1]):
        alike.setdefault(allowed[:, number].tobytes(), []).append(number)
    few = []
    for numbers in alike.values():
        wanted = allowed[:, numbers[0]]
        if not wanted.any():
            continue
        if sum(block.bounds[n + 1] - block.bounds[n] for n in numbers) < FEW:
            few += numbers
            continue
        yield np.concatenate([np.arange(block.bounds[n], block.bounds[n + 1]) for n in numbers]), rows[wanted[local]], None
    if few:
        strategies = np.concatenate([np.arange(block.bounds[n], block.bounds[n + 1]) for n in few])
        some = np.flatnonzero(allowed[:, few].any(axis=1)[local])
        yield strategies, rows[some], (allowed, local[some])


def _reaching(block: InterestBlock, part: Part, best: _Best, unordered: bool = False, single: bool = False,
              only: np.ndarray | None = None, meet: Callable | None = None) -> Iterator[tuple]:
    """(strategies, rows, scores) of the pairs that pass the filters and reach the strategy's floor.

    Rows of a strategy come in their order, and what they reach is known from rows before, or with
    ``unordered`` from any.  With ``single`` a score counts against its threshold as the nearest
    single-precision number.  ``only`` marks the strategies that take part; ``meet(strategies, rows)``
    tells which pairs do.
    """
    slack = (block.units.shape[1] + 8) * 2.0 ** -24 + 1e-6  # error of the product, and six decimals
    span = max(1, KINDS // max(1, len(block.bounds) - 1)) if len(part.kinds) * len(block.bounds) > KINDS else len(part.codes)
    for first in range(0, len(part.codes), span):
        for strategies, rows, wanted in _groups(block, part, np.arange(first, min(first + span, len(part.codes)))):
            strategies = strategies if only is None else strategies[only[strategies]]
            start, size = 0, TILE_ROWS if unordered else min(TILE_ROWS, max(FIRST_ROWS, best.seen))
            while start < len(rows):
                some = rows[start:start + size]
                near, step = part.narrow[some].T, max(1, CELLS // len(some))
                for at in range(0, len(strategies), step):
                    mine = strategies[at:at + step]
                    scores = block.narrow[mine] @ near
                    if wanted is not None:
                        allowed, local = wanted
                        scores[~allowed[local[start:start + size]][:, block.classes[mine]].T] = -np.inf
                    cut = best.floor(mine)
                    if unordered and wanted is None and meet is None and not best.seen and not start and len(some) > best.k:
                        cut = np.maximum(cut, np.partition(scores, -best.k, axis=1)[:, -best.k] - slack)
                    low = (cut - slack).astype(np.float32)
                    alive = np.flatnonzero(~(scores.max(axis=1) < low))  # not a number stays, and reaches nothing below
                    if len(alive) < len(mine):
                        mine, scores, low = mine[alive], scores[alive], low[alive]
                    hit = np.flatnonzero(scores >= low[:, None])
                    if wanted is not None:
                        hit = hit[scores.ravel()[hit] > -np.inf]
                    if not len(hit):
                        continue
                    place, row = np.divmod(hit, len(some))
                    who, row = mine[place], some[row]
                    if meet is not None:
                        both = meet(who, row)
                        who, row = who[both], row[both]
                        if not len(who):
                            continue
                    exact = _exact(block, part, who, row)
                    known = exact >= best.top[who, 0]
                    passing = known & ((exact.astype(np.float32).astype(np.float64) if single else exact) >= best.thresholds[who])
                    who, row, exact = who[passing], row[passing], exact[passing]
                    best.add(who, exact)
                    yield who, row, exact
                start, size = start + size, min(TILE_ROWS, size * 2)
        best.seen += min(first + span, len(part.codes)) - first


def _exact(block: InterestBlock, part: Part, who: np.ndarray, row: np.ndarray) -> np.ndarray:
    pieces = [np.einsum("ij,ij->i", block.units[who[i:i + EMITTED // 4]], part.units[row[i:i + EMITTED // 4]])
              for i in range(0, len(who), EMITTED // 4)]
    return _round6(np.concatenate(pieces))


def _emit(block: InterestBlock, rows: pa.Table, picked: np.ndarray, scores: np.ndarray,
          strategy: np.ndarray) -> pa.RecordBatch:
    """One output row per picked (strategy, row): strategy id, the kept columns, score."""
    kept = rows.take(pa.array(picked)).combine_chunks()
    ids = block.ids.take(pa.array(strategy))
    columns = [column.combine_chunks() for column in kept.columns]
    return pa.RecordBatch.from_arrays(
        [ids, *columns, pa.array(scores)], ["strategy_id", *kept.column_names, "score"])


def _parts(raw: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    return (_part_of(pa.Table.from_batches([batch])) for batch in raw if batch.num_rows)


def _gathered(found: Iterator[tuple], limit: int = EMITTED) -> Iterator[tuple]:
    """The same pairs in fewer pieces."""
    held, size = [], 0
    for piece in found:
        held.append(piece)
        size += len(piece[0])
        if size >= limit:
            yield tuple(np.concatenate(column) for column in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(column) for column in zip(*held))


def _all_scores(block: InterestBlock, parts: Iterable[Part]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for strategy, row, scores in _gathered(_reaching(block, part, _All(len(block.thresholds)))):
            yield _emit(block, part.rows.select(["event_id"]), row, scores, strategy)


def _arrival_scores(block: InterestBlock, parts: Iterable[Part], k: int, single: bool) -> Iterator[pa.RecordBatch]:
    best, latest = _Best(block.thresholds, k), None
    for part in parts:
        rows = part.rows.select(["ingested_at", "event_id"])
        order = pc.sort_indices(rows, [("ingested_at", "ascending"), ("event_id", "ascending")])
        last = [rows[name][order[-1].as_py()].as_py() for name in rows.column_names]
        first = [rows[name][order[0].as_py()].as_py() for name in rows.column_names]
        # The floor may only hold scores of earlier arrivals: start over unless this
        # part lies strictly after everything seen before.
        if latest is not None and not _before(latest, first):
            best = _Best(block.thresholds, k)
        latest = last if latest is None or _before(latest, last) else latest
        if not np.array_equal(order.to_numpy(), np.arange(len(order))):
            at = order.to_numpy()
            part = Part(part.rows.take(order), part.codes[at], part.kinds, part.units[at], part.narrow[at])
        for strategy, row, scores in _gathered(_reaching(block, part, best, single=single)):
            together = np.argsort(strategy, kind="stable")
            yield _emit(block, part.rows.select(["event_id", "ingested_at"]), row[together], scores[together], strategy[together])


def _before(one: list, other: list) -> bool:
    """Whether an arrival (time, id) surely comes before another."""
    return None not in (*one, *other) and one < other


def _corpus_scores(block: InterestBlock, parts: Iterable[Part], k: int, asked: Callable | None = None,
                   floor: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """``asked(part)`` gives the strategies that ask for a part and which of its pairs may meet, ``floor``
    what a score of each strategy must reach to be wanted."""
    best = _Best(np.full(len(block.thresholds), -np.inf) if floor is None else floor, k)
    for part in parts:
        only, meet = asked(part) if asked else (None, None)
        held = None
        for piece in _gathered(_reaching(block, part, best, True, only=only, meet=meet)):
            held = _k_best(piece if held is None else tuple(np.concatenate(pair) for pair in zip(held, piece)), part.places, best)
        if held is not None and len(held[0]):
            strategy, row, scores = held
            yield _emit(block, part.rows.select(["point_id"]), row, scores, strategy)


def _k_best(found: tuple, place: np.ndarray, best: _Best) -> tuple:
    """The k best pairs of every strategy, of equal ones those of the smaller ids."""
    strategy, row, scores = found
    still = np.flatnonzero(scores >= best.floor(strategy))
    strategy, row, scores = strategy[still], row[still], scores[still]
    order = np.lexsort((place[row], -scores, strategy))
    strategy, row, scores = strategy[order], row[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], strategy[1:] != strategy[:-1]])) if len(strategy) else np.zeros(0, int)
    counts = np.diff(np.append(starts, len(strategy)))
    kept = np.arange(len(strategy)) - np.repeat(starts, counts) < best.k
    return strategy[kept], row[kept], scores[kept]


def score_pairs(events: DataFrame, interests: DataFrame, max_block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(strategy_id, event_id, score) of every pair that passes the pre-filter."""
    rows = events.select("event_id", "source", "tickers", "vector")
    return _over_blocks(rows, interests, max_block_bytes, PAIR, _all_scores)


def score_arrivals(events: DataFrame, interests: DataFrame | Registry, k: int = SEARCH_LIMIT,
                   max_block_bytes: int = BLOCK_BYTES, single_precision: bool = False) -> DataFrame:
    """Scores at or above the threshold that may still rank among the first k on arrival.

    A row below its threshold can outrank no row that passes, so it is dropped at once.
    """
    rows = events.select("event_id", "ingested_at", "source", "tickers", "vector")
    return _over_blocks(rows, interests, max_block_bytes, SCORED,
                        lambda block, parts: _arrival_scores(block, parts, k, single_precision), ("ingested_at", "event_id"))


def score_corpus(points: DataFrame, interests: DataFrame, k: int = SEARCH_LIMIT,
                 max_block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(strategy_id, point_id, score) holding at least the k best points per strategy."""
    rows = points.select("point_id", "source", "tickers", "vector")
    return _over_blocks(rows, interests, max_block_bytes, FOUND, lambda block, parts: _corpus_scores(block, parts, k))


def score_buckets(points: DataFrame, interests: DataFrame, k: int = SEARCH_LIMIT) -> DataFrame:
    """The same among the pairs that agree at some place of their ``buckets``, lists of one length."""
    def scores(block: InterestBlock, parts: Iterable[Part]) -> Iterator[pa.RecordBatch]:
        def asked(part: Part) -> tuple:
            mine = _matrix(part.rows["buckets"])
            return None, lambda who, row: (block.buckets[who] == mine[row]).any(axis=1)
        return _corpus_scores(block, parts, k, asked)

    rows = points.select("point_id", "source", "tickers", "vector", "buckets")
    return _over_blocks(rows, interests, BLOCK_BYTES, FOUND, scores, extra=("buckets",))
