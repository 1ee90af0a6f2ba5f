"""Matching whose registry is itself a stream: edits arrive as a second, tagged input of the matcher.

Strategies are dealt into shards by hash; a shard is the key, its strategies and their k best scores
are its state.  Events are copied once per shard, as the scoring of a large registry does.  The state
begins with a given registry (``initialState``), and edits take effect at their own time.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.scoring import SCORED, TILE_ROWS, InterestBlock, _Best, _block_of, _part_of, _reaching
from tidewatch.schemas import SEARCH_LIMIT
from tidewatch.session import scratch_path
from tidewatch.streaming.ordered import HELD_BYTES, in_order
from tidewatch.streaming.retry import ROCKSDB

EDIT, EVENT, SEED = "edit", "event", "seed"  # at one instant edits come first
RUN = 8192  # events scored at once
_BEGINNING = -(1 << 63)
_ROW_BYTES = 800  # of a row besides its vector
_STRATEGY = T.StructType([
    T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("tickers", T.ArrayType(T.StringType())),
    T.StructField("vector", T.BinaryType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("active", T.BooleanType()), T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("events", T.ArrayType(T.StringType()))])
_ID = T.StructType([T.StructField("strategy_id", T.StringType())])
_SEEDED = T.StructType([T.StructField("seeded", T.BooleanType())])
_MATCH = Row("strategy_id", "event_id", "ingested_at", "score", "rank")


class _Strategy:
    __slots__ = ("sources", "tickers", "vector", "threshold", "active", "best")

    def __init__(self, sources, tickers, vector, threshold, active, scores=(), events=()) -> None:
        self.sources, self.tickers, self.vector = sources or [], tickers or [], np.asarray(vector)
        self.threshold, self.active = threshold or 0.0, bool(active)
        self.best = list(zip(scores or (), events or (), strict=True))

    def row(self) -> tuple:
        return (self.sources, self.tickers, self.vector.tobytes(), self.threshold, self.active,
                [score for score, _ in self.best], [event for _, event in self.best])

    def rank(self, score: float, event: str, k: int) -> int | None:
        """The rank of an event on arrival, which is kept if it is within k."""
        self.best = [kept for kept in self.best if kept[1] != event]  # delivered again: it replaces itself
        above = sum(kept > score for kept, _ in self.best)
        if above >= k:
            return None
        insort(self.best, (score, event))
        self.best = self.best[-k:]
        return above + 1


class _Event(NamedTuple):
    at: int  # microseconds
    kind: str
    id: str
    source: str | None
    tickers: tuple
    vector: np.ndarray | None


def _listed(vectors: list) -> pa.ListArray:
    flat = np.concatenate([np.asarray(v) for v in vectors])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * (len(flat) // len(vectors)), pa.int32()), pa.array(flat))


def _block(rows: list[tuple]) -> InterestBlock:
    names, sources, tickers, vectors = zip(*rows)
    lists = pa.list_(pa.string())
    return _block_of(pa.table({
        "strategy_id": pa.array(names, pa.string()), "wanted_sources": pa.array(sources, lists), "wanted_tickers": pa.array(tickers, lists),
        "threshold": np.full(len(names), -np.inf), "query_vector": _listed(vectors)}))


def _keep(best: _Best, place: int, strategy: _Strategy) -> None:
    """What the strategy keeps is what counts from here on."""
    scores = [score for score, _ in strategy.best][-best.k:]
    best.top[place] = [*[-np.inf] * (best.k - len(scores)), *scores]


class _Prepared(NamedTuple):
    """The strategies of one vector length as they are scored, and hashes of the events they keep or kept."""

    block: InterestBlock
    ids: list[str]
    named: dict[str, _Strategy]
    best: _Best
    met: np.ndarray


class _Shard(StatefulProcessor):
    def __init__(self, k: int, kind: str = "float32") -> None:
        self.k, self.kind = k, np.dtype(kind)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("strategies", _ID, _STRATEGY)
        self.seeded = handle.getValueState("seeded", _SEEDED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Holds the shard's strategies, a run of events, and a bounded part of the rows as they are sorted."""
        found = self._handled(rows)
        while some := list(islice(found, RUN)):
            yield pd.DataFrame(some, columns=["strategy_id", "event_id", "ingested_at", "score", "rank"])

    def _handled(self, rows: Iterator[pd.DataFrame]) -> Iterator[Row]:
        lists: dict[tuple, list] = {}  # equal ones are held once
        strategies = {}
        for (name,), (sources, tickers, vector, *others) in self.kept.iterator():
            shared = (lists.setdefault(tuple(values), values) for values in (sources, tickers))
            strategies[name] = _Strategy(*shared, np.frombuffer(vector, self.kind), *others)
        fresh, touched, run, prepared = not self.seeded.exists(), set(), [], {}
        weight = lambda row: _ROW_BYTES + len(row[5] or b"")
        for row in in_order(self._rows(rows), itemgetter(0, 1, 2), weight, HELD_BYTES):
            at, kind, name, sources, tickers, vector, threshold, active = row
            vector = None if vector is None else np.frombuffer(vector, self.kind)
            if kind == EVENT:
                run.append(_Event(at, kind, name, sources and sources[0], tuple(tickers or ()), vector))
                if len(run) == RUN:
                    yield from self._match(strategies, run, touched, prepared)
                    run = []
                continue
            if kind == SEED and not fresh:
                continue
            yield from self._match(strategies, run, touched, prepared)
            run = []
            prepared.clear()
            touched.add(name)
            if vector is None:
                strategies.pop(name, None)
            else:
                sources, tickers = (lists.setdefault(tuple(values or ()), values or []) for values in (sources, tickers))
                strategies[name] = _edited(strategies.get(name), _Strategy(sources, tickers, vector, threshold, active))
        yield from self._match(strategies, run, touched, prepared)
        for name in touched:
            if name in strategies:
                self.kept.updateValue((name,), strategies[name].row())
            elif self.kept.containsKey((name,)):
                self.kept.removeKey((name,))
        if fresh:
            self.seeded.update((True,))

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        def listed(values):
            return None if values is None else list(values)

        for frame in frames:
            columns = (frame[name].tolist() for name in ("at", "kind", "id", "sources", "tickers", "vector", "threshold", "active"))
            for at, kind, name, sources, tickers, vector, threshold, active in zip(*columns):
                yield (at, kind, name, listed(sources), listed(tickers),
                       None if vector is None else np.asarray(vector, self.kind).tobytes(), threshold, active)

    def _prepared(self, strategies: dict[str, _Strategy], length: int) -> _Prepared | None:
        named = {name: s for name, s in sorted(strategies.items()) if len(s.vector) == length}
        if not named:
            return None
        block = _block([(name, s.sources, s.tickers, s.vector) for name, s in named.items()])
        ids = block.ids.to_pylist()
        best = _Best(np.full(len(ids), -np.inf), self.k)
        best.seen = 0 if any(len(s.best) < self.k for s in named.values()) else TILE_ROWS
        for i, name in enumerate(ids):
            _keep(best, i, named[name])
        return _Prepared(block, ids, named, best, _hashes(event for s in named.values() for _, event in s.best))

    def _match(self, strategies: dict[str, _Strategy], events: list[_Event], touched: set, prepared: dict | None = None) -> Iterator[Row]:
        """Events between two edits: matrix products per vector length, then what may still rank.

        An event that is delivered again may lower what its strategies keep, so it goes alone.  ``prepared`` holds
        what was made of the same strategies for events before.
        """
        prepared = {} if prepared is None else prepared
        for length in sorted({len(e.vector) for e in events if e.vector is not None}):
            if length not in prepared:
                prepared[length] = self._prepared(strategies, length)
            if prepared[length] is None:
                continue
            block, ids, named, best, met = prepared[length]
            mine = [e for e in events if e.vector is not None and len(e.vector) == length]
            hashes = np.fromiter((hash(e.id) for e in mine), np.int64, len(mine))
            repeated = np.ones(len(mine), bool)
            repeated[np.unique(hashes, return_index=True)[1]] = False
            alone = np.flatnonzero(repeated | np.isin(hashes, met))
            kept: set[str] = set()
            for start, at in zip([0, *(alone + 1).tolist()], [*alone.tolist(), len(mine)]):
                if start < at:
                    yield from self._rank(block, ids, named, best, mine[start:at], touched, kept)
                if at < len(mine):
                    again = mine[at]
                    for i, name in enumerate(ids):
                        if any(event == again.id for _, event in named[name].best):
                            best.top[i] = -np.inf  # whatever it scores now, it is ranked
                    yield from self._rank(block, ids, named, best, [again], touched, kept)
                    for i in np.flatnonzero(best.top[:, 0] == -np.inf):
                        _keep(best, i, named[ids[i]])
            prepared[length] = prepared[length]._replace(met=np.union1d(met, _hashes(kept)))

    def _rank(self, block: InterestBlock, ids: list[str], named: dict[str, _Strategy], best: _Best,
              events: list[_Event], touched: set, met: set) -> Iterator[Row]:
        part = _part_of(pa.table({
            "source": pa.array([e.source for e in events], pa.string()),
            "tickers": pa.array([list(e.tickers) for e in events], pa.list_(pa.string())), "vector": _listed([e.vector for e in events])}))
        for strategy, row, scores in _reaching(block, part, best):
            for i, at, score in zip(strategy.tolist(), row.tolist(), scores.tolist()):
                event, kept = events[at], named[ids[i]]
                rank = kept.rank(score, event.id, self.k)
                if rank is not None:
                    touched.add(ids[i])
                    met.add(event.id)
                    if kept.active and score >= kept.threshold:
                        yield _MATCH(ids[i], event.id, event.at, score, rank)

    def close(self) -> None:
        pass


def _hashes(names) -> np.ndarray:
    """Equal names have equal numbers within a process; what else has them is only taken for equal."""
    return np.unique(np.fromiter((hash(name) for name in names), np.int64))


def _edited(before: _Strategy | None, after: _Strategy) -> _Strategy:
    """The strategy after an edit; it keeps its best scores unless what it looks for has changed."""
    if before and (before.sources, before.tickers) == (after.sources, after.tickers) and np.array_equal(before.vector, after.vector):
        after.best = before.best
    return after


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")


def edits(rows: DataFrame, at: Column) -> DataFrame:
    """Registry rows (id, source, tickers, query_vector, similarity_threshold, is_active) as edits at
    their time; a row without a vector removes its strategy."""
    return rows.select(
        F.lit(EDIT).alias("kind"), at.alias("at"), F.col("id").cast("string").alias("id"), F.col("source").alias("sources"),
        "tickers", F.col("query_vector").cast("array<float>").alias("vector"),
        F.col("similarity_threshold").cast("double").alias("threshold"), F.col("is_active").alias("active"))


def stream_matches(arrivals: DataFrame, changes: DataFrame, registry: DataFrame, shards: int, k: int = SEARCH_LIMIT) -> DataFrame:
    """(strategy_id, event_id, ingested_at, score, rank) of a stream of arrivals under a stream of edits.

    ``changes`` is a stream and ``registry`` a table, both made by ``edits``.  Within a micro-batch the
    order is (time, edits first, id).  An inactive strategy is ranked on without alerts, so that a
    toggle or a new threshold gives the ranks of everything seen.  A strategy that is new or looks for
    something else ranks what comes after; ``EventJob``, which keeps the corpus, searches it for those.

    A shard's strategies are in memory together: choose ``shards`` by the size of the registry, and leave it
    for a checkpoint.  Events are copied once per shard, and those of a micro-batch are sorted within a bound
    of memory.  Rows without a time or id take no part.
    """
    return shard_matches(arrivals, changes, registry, shards, k, "float")


def shard_matches(arrivals: DataFrame, changes: DataFrame | None, registry: DataFrame, shards: int, k: int, kind: str) -> DataFrame:
    """The same, also without edits; vectors are of ``kind``, float or double.

    The registry is written and read as a stream of its own, in the first micro-batch; a shard that has begun takes
    no more of it.  (An initial state would hold all rows of a shard's first micro-batch in the Python worker.)
    """
    spark = arrivals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    vector = F.col("vector").cast(f"array<{kind}>").alias("vector")
    events = arrivals.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(EVENT).alias("kind"),
        F.unix_micros("ingested_at").alias("at"), F.col("event_id").alias("id"), F.array("source").alias("sources"), "tickers",
        vector, F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("boolean").alias("active"))
    seeds = registry.where("id is not null and vector is not null").select(
        _shard(shards), F.lit(SEED).alias("kind"), F.lit(_BEGINNING).alias("at"), "id", "sources", "tickers", vector, "threshold", "active")
    path = scratch_path(spark, "seed")
    seeds.write.parquet(path)
    tagged = events
    if changes is not None:
        tagged = tagged.unionByName(changes.select(_shard(shards), "*").withColumns({"at": F.unix_micros("at"), "vector": vector}))
    # What is null is filled in where a column of a frame would turn into another type.
    tagged = tagged.where("at is not null and id is not null").unionByName(spark.readStream.schema(seeds.schema).parquet(path)).withColumns({
        "threshold": F.coalesce("threshold", F.lit(0.0)), "active": F.coalesce("active", F.lit(False))})
    found = tagged.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=_Shard(k, np.dtype("float32" if kind == "float" else "float64").name), outputMode="Append", timeMode="None",
        outputStructType=f"{SCORED.replace('ingested_at timestamp', 'ingested_at long')}, rank int")
    return found.withColumn("ingested_at", F.timestamp_micros("ingested_at"))
