"""Rank at arrival as a stateful stream: the k best scores per strategy are the state."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.scoring import BLOCK_BYTES, SCORED, measured, score_arrivals
from tidewatch.schemas import SEARCH_LIMIT
from tidewatch.streaming.registry_stream import shard_matches

SHARDS = 12  # of a registry that is no single block
_AGAIN = "\u0001"  # between the id of a repeated strategy and its number
_STATE = T.StructType([T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("events", T.ArrayType(T.StringType()))])
_MATCH = Row("strategy_id", "event_id", "ingested_at", "score", "rank")
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _RankAtArrival(StatefulProcessor):
    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = list(zip(*self.best.get())) if self.best.exists() else []
        for at, event, new in sorted(found for row in rows for found in zip(row.times, row.events, row.scores)):
            best = [kept for kept in best if kept[1] != event]  # delivered again: it replaces itself
            above = sum(score > new for score, _ in best)
            if above < self.k:
                insort(best, (new, event))
                best = best[-self.k:]
                yield _MATCH(key[0], event, at, new, above + 1)
        self.best.update(([score for score, _ in best], [event for _, event in best]))

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a strategy as one, since a state takes its rows one by one."""
    for batch in batches:
        if batch.num_rows:
            runs = pc.run_end_encode(batch["strategy_id"])
            offsets = pa.array([0, *runs.run_ends.to_pylist()], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch[name]) for name in ("event_id", "ingested_at", "score")]
            yield pa.RecordBatch.from_arrays([runs.values, *lists], ["strategy_id", "events", "times", "scores"])


def stream_matches(arrivals: DataFrame, interests: DataFrame, k: int = SEARCH_LIMIT,
                   max_block_bytes: int = BLOCK_BYTES, shards: int = SHARDS) -> DataFrame:
    """(strategy_id, event_id, ingested_at, score, rank) of a stream of arrivals.

    Scoring and pruning run before the shuffle, so a busy strategy receives only the
    rows of the micro-batch that may still rank.  State is k numbers per strategy,
    whatever the size of the corpus.  Micro-batches are the order of arrival; inside one
    it is (ingested_at, event_id).  The registry is read when the stream starts; use
    ``EventJob`` to follow registry changes per batch.  An event delivered again takes the
    place of its earlier score; what had been outranked by that score is not searched for,
    since the stream keeps no corpus (``EventJob`` does).

    A registry beyond ``max_block_bytes`` is not shipped: its strategies are the state of shards, as in
    ``registry_stream``, read when the stream first starts.  A strategy that comes twice ranks twice.
    """
    spark = arrivals.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    registry = measured(interests)
    if registry.bytes > max(max_block_bytes, registry.row):
        kinds = {frame.schema[name].dataType.elementType for frame, name in ((arrivals, "vector"), (registry.rows, "query_vector"))}
        number = F.row_number().over(W.partitionBy("strategy_id").orderBy("threshold"))
        name = F.when(number == 1, F.col("strategy_id")).otherwise(F.concat("strategy_id", F.lit(_AGAIN), number))
        seeds = registry.rows.select(
            name.alias("id"), F.col("wanted_sources").alias("sources"), F.col("wanted_tickers").alias("tickers"),
            F.col("query_vector").alias("vector"), "threshold", F.lit(True).alias("active"))
        usable = arrivals.where(F.size("vector") == registry.dim)
        found = shard_matches(usable, None, seeds, shards, k, "float" if kinds == {T.FloatType()} else "double")
        return found.withColumn("strategy_id", F.substring_index("strategy_id", _AGAIN, 1))
    scored = score_arrivals(arrivals, registry, k, max_block_bytes).mapInArrow(
        _packed, "strategy_id string, events array<string>, times array<timestamp>, scores array<double>")
    return scored.groupBy("strategy_id").transformWithState(
        statefulProcessor=_RankAtArrival(k),
        outputStructType=f"{SCORED}, rank int",
        outputMode="Append",
        timeMode="None",
    )
