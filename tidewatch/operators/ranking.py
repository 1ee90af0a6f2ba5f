"""Rank at arrival, top-k search and the alerts that follow from them."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.predicates import reaches_threshold
from tidewatch.operators.scoring import BLOCK_BYTES, SCORED, score_arrivals, score_corpus
from tidewatch.schemas import SEARCH_LIMIT
from tidewatch.session import materialise

_ORDER = ["strategy_id", "ingested_at", "event_id"]


def _fold(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rank within one sorted partition: one strategy at a time, k scores in memory.

    Where a strategy ends its k best scores follow as rows without an event, ``above_in_chunk`` -1.
    """
    chunk = TaskContext.get().partitionId()
    current, best, fields = None, [], None
    for batch in batches:
        rows, outranked_by, ended = [], [], []
        strategies, scores = batch.column("strategy_id").to_pylist(), batch.column("score").to_pylist()
        for row, (strategy, score) in enumerate(zip(strategies, scores)):
            if strategy != current:
                ended.append((current, best))
                current, best = strategy, []
            above = len(best) - bisect_right(best, score)
            if above < k:
                rows.append(row)
                outranked_by.append(above)
                insort(best, score)
                if len(best) > k:
                    best.pop(0)
        if rows:
            yield _in_chunk(batch.take(pa.array(rows)), chunk, outranked_by)
        fields = batch.schema
        yield from _best_rows(ended, fields, chunk)
    if fields is not None:
        yield from _best_rows([(current, best)], fields, chunk)


def _in_chunk(rows: pa.RecordBatch, chunk: int, outranked_by: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array([chunk] * rows.num_rows, pa.int32()), pa.array(outranked_by, pa.int32())],
        [*rows.schema.names, "chunk", "above_in_chunk"],
    )


def _best_rows(ended: list[tuple], fields: pa.Schema, chunk: int) -> Iterator[pa.RecordBatch]:
    found = [(strategy, score) for strategy, best in ended for score in best]
    if found:
        known = dict(zip(("strategy_id", "score"), zip(*found)))
        columns = [pa.array(known.get(field.name, [None] * len(found)), field.type) for field in fields]
        yield _in_chunk(pa.RecordBatch.from_arrays(columns, fields.names), chunk, [-1] * len(found))


def _prefixes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per (strategy, chunk): the k best scores of that strategy's earlier chunks."""
    current, best = None, []
    for batch in batches:
        ids, chunks, earlier = [], [], []
        columns = (batch.column(name).to_pylist() for name in ("strategy_id", "chunk", "scores"))
        for strategy, chunk, scores in zip(*columns):
            if strategy != current:
                current, best = strategy, []
            elif best:
                ids.append(strategy)
                chunks.append(chunk)
                earlier.append(best)
            best = sorted([*best, *scores])[-k:]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(chunks, pa.int32()),
             pa.array(earlier, pa.list_(pa.float64()))],
            ["strategy_id", "chunk", "earlier"],
        )


def best_scores(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows per key; the limit also runs before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.col("score").desc())
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def rank_at_arrival(scored: DataFrame, k: int = SEARCH_LIMIT, seed: DataFrame | None = None) -> DataFrame:
    """Rows among the first k of their strategy when they arrived, with that ``rank``.

    rank = 1 + earlier rows of the strategy with a strictly higher score.  Order of
    arrival is (ingested_at, event_id).  ``seed`` (strategy_id, score) holds best scores
    from before the first row.

    Rows are range-partitioned by (strategy, arrival): a busy strategy spreads over as
    many neighbouring partitions as its rows need, and each is folded as a stream with
    k scores in memory.  Only the k best scores of each (strategy, partition) travel on
    to correct the ranks of later partitions.
    """
    scored = materialise(scored, "scored")
    ordered = scored.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    local = materialise(
        ordered.mapInArrow(lambda it: _fold(it, k), f"{SCORED}, chunk int, above_in_chunk int"),
        "candidates",
    )
    best = local.where("above_in_chunk < 0").select("strategy_id", "chunk", "score")
    if seed is not None:
        best = best.unionByName(seed.select("strategy_id", F.lit(-1).alias("chunk"), "score"))
    summary = best.groupBy("strategy_id", "chunk").agg(F.collect_list("score").alias("scores"))
    # Written, so that the planner knows how few they are and does not shuffle the candidates to meet them.
    earlier = materialise(
        summary.repartition("strategy_id")
        .sortWithinPartitions("strategy_id", "chunk")
        .mapInArrow(lambda it: _prefixes(it, k), "strategy_id string, chunk int, earlier array<double>"),
        "earlier",
    )
    above_before = F.coalesce(
        F.size(F.filter("earlier", lambda x: x > F.col("score"))), F.lit(0)
    )
    return (
        local.where("above_in_chunk >= 0").join(earlier, ["strategy_id", "chunk"], "left")
        .withColumn("rank", (F.lit(1) + F.col("above_in_chunk") + F.greatest(above_before, F.lit(0))).cast("int"))
        .where(F.col("rank") <= k)
        .select(*_ORDER, "score", "rank")
    )


def match_at_arrival(events: DataFrame, interests: DataFrame, k: int = SEARCH_LIMIT,
                     seed: DataFrame | None = None, max_block_bytes: int = BLOCK_BYTES,
                     single_precision: bool = False) -> DataFrame:
    """(strategy_id, ingested_at, event_id, score, rank) of every alert, event ids unique.

    ``single_precision`` compares scores with thresholds as a vector store that keeps floats does: a
    score of 0.7 is then below a threshold of 0.7.
    """
    return rank_at_arrival(score_arrivals(events, interests, k, max_block_bytes, single_precision), k, seed)


def vector_search(points: DataFrame, interests: DataFrame, k: int = SEARCH_LIMIT, method: str = "exact",
                  max_block_bytes: int = BLOCK_BYTES, **lsh) -> DataFrame:
    """(strategy_id, point_id, score, rank): the k best points that pass each filter.

    Ties are broken by point id.  ``method="lsh"`` looks in hash buckets first and
    searches exactly only where the buckets held fewer than k points.
    """
    if method == "lsh":
        from tidewatch.operators.lsh import search_lsh
        return search_lsh(points, interests, k, **lsh)
    return top_points(score_corpus(points, interests, k, max_block_bytes), k)


def top_points(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("strategy_id").orderBy(F.col("score").desc(), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def match_in_corpus(hits: DataFrame, events: DataFrame, interests: DataFrame) -> DataFrame:
    """Events found among the hits of a search at or above the threshold."""
    thresholds = interests.select("strategy_id", "threshold")
    return (
        hits.join(thresholds, "strategy_id")
        .where(reaches_threshold("score", "threshold"))
        .join(events, "point_id")
    )
