"""Exact search over a clustered corpus: cells of near vectors, skipped when a bound proves it.

A corpus is dealt into cells around centers and stored by cell.  A cell knows its center and its
radius, the greatest angle of a member to the center, and which wanted sources and tickers its
members have.  No member is nearer to a query than the
angle between query and center less the radius, so a cell whose best possible cosine is below a
strategy's k-th best score so far holds nothing for that strategy.

Two passes read the corpus: the first the nearest cells of every strategy, until they hold k
points, which gives a score to beat; the second the other cells that may still beat it, and of those
it hands on only what reaches that score.  A cell is read
only for the strategies that ask for it, and not at all if none does.  Centers come from a bounded
sample, which decides how much is skipped, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import scoring
from tidewatch.operators.ranking import top_points
from tidewatch.schemas import SEARCH_LIMIT
from tidewatch.session import materialise, scratch_path, share

SAMPLE = 20_000      # most vectors that centers are learned from
SLACK = 2e-6         # scores are rounded to six decimals
_POINT = "point_id string, source string, tickers array<string>, vector array<float>, cell int, angle double"


@dataclass
class Cells:
    """``points`` by cell, and per cell center, radius (as an angle) and number of points."""

    points: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray


def _angles(units: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centers.T, -1.0, 1.0))


def build_cells(points: DataFrame, cells: int = 64, seed: int = 11, sample: int = SAMPLE) -> Cells:
    """Deal (point_id, source, tickers, vector) into about that many cells and write them.

    Vectors of another length than most take no part, as in every search.
    """
    spark = points.sparkSession
    there = materialise(points.where("vector is not null").select("point_id", "source", "tickers", "vector"), "points")
    usual = there.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if usual is None:
        return Cells(points.limit(0).withColumn("cell", F.lit(0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0, int))
    usable = there.where(F.size("vector") == usual.dim)
    chosen = usable.orderBy(F.xxhash64("point_id")).limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    norm = F.aggregate(F.col("vector"), F.lit(0.0), lambda total, x: total + x * x)
    nonzero = chosen if usable.where(norm == 0).isEmpty() else usable.where(norm > 0).orderBy(F.xxhash64("point_id")).limit(sample).select(
        array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, distanceMeasure="cosine").fit(nonzero)
    centers = scoring._unit_rows(np.array(model.clusterCenters()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(scoring._unit_rows(scoring._matrix(batch.column("vector"))), centers)
                cell = angles.argmin(axis=1)
                yield batch.append_column("cell", pa.array(cell.astype(np.int32))).append_column("angle", pa.array(angles[np.arange(len(cell)), cell]))

    path = scratch_path(spark, "cells")
    usable.mapInArrow(deal, _POINT).repartition("cell").write.partitionBy("cell").parquet(path)
    stored = spark.read.parquet(path)
    radius, sizes = np.zeros(len(centers)), np.zeros(len(centers), int)
    for cell, far, n in stored.groupBy("cell").agg(F.max("angle"), F.count(F.lit(1))).collect():  # one row per cell
        radius[cell], sizes[cell] = far, n
    return Cells(stored, centers, radius, sizes)


@dataclass
class Found:
    hits: DataFrame
    read: int        # (strategy, cell) pairs that were scored
    pairs: int       # all such pairs
    cells_read: int  # cells that were opened at all


def search_cells(cells: Cells, interests: DataFrame, k: int = SEARCH_LIMIT) -> Found:
    """The same hits as ``vector_search`` for a registry of one block, and how much of the corpus it read."""
    registry, dim, size, _ = scoring.measured(interests)
    if size > scoring.BLOCK_BYTES:
        raise ValueError("a registry of several blocks is searched with vector_search")
    spark = cells.points.sparkSession
    if not len(cells.centers) or not size or dim != cells.centers.shape[1]:
        return Found(spark.createDataFrame([], f"{scoring.FOUND}, rank int"), 0, 0, 0)
    block = scoring._block_of(registry.toArrow())
    best = np.cos(np.maximum(0.0, _angles(block.units, cells.centers) - cells.radius)) + SLACK
    best[:, cells.sizes == 0] = -np.inf
    silent = (block.units == 0).all(axis=1)  # a query of length 0 scores 0 with everything
    best[np.ix_(silent, cells.sizes > 0)] = SLACK
    best[~_passes(cells, block)] = -np.inf
    near = _nearest(best, cells.sizes, k)
    first = materialise(top_points(_scored(cells, block, near, k), k).drop("rank"), "near-cells")
    floor = np.full(len(block.thresholds), -np.inf)
    place = {name: number for number, name in enumerate(block.ids.to_pylist())}
    full = first.groupBy("strategy_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    for row in full.toLocalIterator():  # at most one row per strategy of the block
        floor[place[row.strategy_id]] = row.least
    rest = (best >= floor[:, None]) & ~near & np.isfinite(best)
    scored = first.unionByName(_scored(cells, block, rest, k, floor))
    asked = near | rest
    return Found(top_points(scored, k), int(asked.sum()), len(block.thresholds) * int((cells.sizes > 0).sum()), int(asked.any(axis=0).sum()))


def _passes(cells: Cells, block: scoring.InterestBlock) -> np.ndarray:
    """strategy x cell: whether some member may pass the filters of the strategy's class.

    Of the values in the cells only those that the registry names come to the driver.
    """
    spark = cells.points.sparkSession
    result = []
    for any_value, by_value, held in ((block.any_source, block.by_source, F.array("source")), (block.any_ticker, block.by_ticker, F.col("tickers"))):
        there = np.repeat(any_value[:, None], len(cells.centers), axis=1)
        if by_value:
            named = spark.createDataFrame([(value,) for value in by_value], "value string")
            inside = cells.points.select("cell", F.explode(held).alias("value")).join(F.broadcast(named), "value").distinct()
            for cell, value in inside.select("cell", "value").toLocalIterator():
                there[by_value[value], cell] = True
        result.append(there)
    return (result[0] & result[1])[block.classes]


def _nearest(best: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Per strategy the most promising cells that together hold ``k`` points."""
    order = np.argsort(-best, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    asked = np.zeros(best.shape, bool)
    np.put_along_axis(asked, order, before < k, axis=1)
    return asked & np.isfinite(best)


def _scored(cells: Cells, block: scoring.InterestBlock, asked: np.ndarray, k: int, floor: np.ndarray | None = None) -> DataFrame:
    """(strategy_id, point_id, score) of the asked (strategy, cell) pairs: at least the k best of each task
    that reach the strategy's ``floor``."""
    spark = cells.points.sparkSession
    wanted = [int(cell) for cell in np.flatnonzero(asked.any(axis=0))]
    shared = share(spark, (block, asked, floor))

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("cell")
            edges = [0, *(np.flatnonzero(np.diff(batch["cell"].to_numpy())) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(start, end - start) for start, end in zip(edges, edges[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked, floor = shared.value
        return scoring._corpus_scores(block, scoring._parts(by_cell(batches)), k,
                                      lambda part: (asked[:, part.rows["cell"][0].as_py()], None), floor)

    opened = cells.points.where(F.col("cell").isin(wanted)) if wanted else cells.points.limit(0)
    return opened.select("point_id", "source", "tickers", "vector", "cell").mapInArrow(run, scoring.FOUND)
