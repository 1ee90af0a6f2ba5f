"""Centroid clustering with heap-ordered bounds.

Each cluster of a block of vectors keeps a heap of gaps: the distance to the second nearest
centroid less that to the own one, plus the drift the cluster had accumulated when the vector
was scanned.  In a round the own centroid comes closer to a rival by at most its own movement
and the largest other movement; that sum is added to the cluster's drift.  Only vectors on top
of a heap whose gap is used up are popped, scanned against all centroids exactly, and pushed
into the heap of their cluster; all others stay where they are without a look at their numbers.

Vectors are cut into blocks of ``BLOCK_ROWS`` rows where they are read; a block and its heaps are
one row, rewritten to the shared folder in every round.  Tasks hand on only what moved: per
block and changed cluster a count and sums, added up by Spark.  The driver holds ``k`` centroids.

Defined results: components become floor(256 x).  Vectors of another length, and those holding a
null, a non-finite component or one of 2^19 or more in magnitude (whose squared distances would
not fit a long), take no part; null ids take part and are the last to become centroids; repeated
rows are clustered row by row; with fewer than ``k`` vectors each is a centroid; an empty table
gives no rows.  Ties go to the smaller cluster number.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise, ship_package

BLOCK_ROWS = 8_192
#: Larger magnitudes of a component have no squared distance that fits a long.
LARGEST = float(1 << 19)
_BLOCK = ("block long, ids array<long>, vectors binary, heap_rows binary, heap_keys binary, heap_sizes binary, "
          "scanned long, moved array<struct<cluster: int, n: long, sums: array<long>>>")
_ASSIGNED = "vec_id long, cluster int, distance long"


def whole_components(vector: Column, dim: int) -> Column:
    """floor(256 x) of every component as an int, null where the vector takes no part."""
    usable = (F.size(vector) == dim) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= LARGEST))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("int")))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``<salt>:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([row[0] for row in rows], np.int64)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids; by floating products where those are exact."""
    peak = 2 * max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if vectors.shape[1] * peak * peak < 1 << 53 else np.int64
    x, c = vectors.astype(kind), centroids.astype(kind)
    squares = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
    return squares.astype(np.int64)


class Heaps:
    """One heap of (gap + drift at the time, row) per cluster; rows are those of one block."""

    def __init__(self, heaps: list[list[tuple[float, int]]]) -> None:
        self.heaps = heaps

    @classmethod
    def stored(cls, rows: bytes, keys: bytes, sizes: bytes) -> Heaps:
        """Heaps as they were written: their order is kept, so nothing has to be ordered anew."""
        pairs = list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(rows, "<i4").tolist()))
        ends = np.cumsum(np.frombuffer(sizes, "<i4")).tolist()
        return cls([pairs[start:end] for start, end in zip([0, *ends[:-1]], ends)])

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        pairs = [pair for heap in self.heaps for pair in heap]
        return (np.array([row for _, row in pairs], "<i4").tobytes(), np.array([key for key, _ in pairs], "<f8").tobytes(),
                np.array([len(heap) for heap in self.heaps], "<i4").tobytes())

    def pop(self, drift: np.ndarray, slack: float) -> tuple[list[int], list[int]]:
        """(rows, clusters) whose gap may be used up by the drift of their cluster."""
        rows, clusters = [], []
        for cluster, heap in enumerate(self.heaps):
            limit = drift[cluster] + slack
            while heap and heap[0][0] <= limit:
                rows.append(heapq.heappop(heap)[1])
                clusters.append(cluster)
        return rows, clusters

    def push(self, rows: list[int], clusters: list[int], keys: list[float]) -> None:
        for row, cluster, key in zip(rows, clusters, keys):
            heapq.heappush(self.heaps[cluster], (key, row))

    def labels(self, rows: int) -> np.ndarray:
        found = np.zeros(rows, np.int64)
        for cluster, heap in enumerate(self.heaps):
            found[[row for _, row in heap]] = cluster
        return found


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, gap to the second nearest) of an exact scan; the smaller number wins a tie."""
    squares = squared_distances(vectors, centroids)
    best = squares.argmin(axis=1)
    own = squares[np.arange(len(best)), best]
    if centroids.shape[0] == 1:
        return best, np.full(len(best), np.inf)
    squares[np.arange(len(best)), best] = np.iinfo(np.int64).max
    return best, np.sqrt(squares.min(axis=1)) - np.sqrt(own)


def _moves(vectors: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> list[dict]:
    """What the clusters gained and lost in this block; ``old`` is -1 for vectors without a cluster yet."""
    changed = old != new
    counts, sums = np.zeros(k, np.int64), np.zeros((k, vectors.shape[1]), np.int64)
    for labels, sign in ((new[changed], 1), (old[changed], -1)):
        there = labels >= 0
        np.add.at(counts, labels[there], sign)
        np.add.at(sums, labels[there], sign * vectors[changed][there])
    touched = np.flatnonzero((counts != 0) | sums.any(axis=1))
    return [{"cluster": int(c), "n": int(counts[c]), "sums": sums[c].tolist()} for c in touched]


class _Round:
    """What the tasks of a round need: centroids, drift per cluster and the float slack."""

    def __init__(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        self.centroids, self.drift = centroids, drift
        #: Far above the rounding of the square roots and sums, far below a gap that matters.
        self.slack = 1e-9 * (1.0 + float(np.abs(centroids).max(initial=0)) * centroids.shape[1])

    def scan(self, vectors: np.ndarray, heaps: Heaps, rows: list[int]) -> np.ndarray:
        found, gaps = nearest(vectors[rows], self.centroids)
        heaps.push(rows, found.tolist(), (gaps + self.drift[found]).tolist())
        return found

    def after(self, centroids: np.ndarray) -> _Round:
        """The next round: every cluster drifts by its own movement and the largest other one."""
        moved = np.sqrt(((centroids - self.centroids).astype(np.float64) ** 2).sum(axis=1))
        others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))])
        return _Round(centroids, self.drift + moved + others)


def _stored_blocks(rows: list[dict]):
    import pyarrow as pa

    moved = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("heap_rows", pa.binary()),
                        ("heap_keys", pa.binary()), ("heap_sizes", pa.binary()), ("scanned", pa.int64()), ("moved", moved)])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _block_row(block: int, ids: list, vectors: np.ndarray, heaps: Heaps, scanned: int, moved: list[dict]) -> dict:
    rows, keys, sizes = heaps.bytes()
    return {"block": block, "ids": ids, "vectors": vectors.astype("<i4").tobytes(), "heap_rows": rows, "heap_keys": keys,
            "heap_sizes": sizes, "scanned": scanned, "moved": moved}


def _first_assignment(kept: DataFrame, now: _Round, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors with their heaps, every vector scanned once."""
    k, dim = now.centroids.shape

    def cut(batches: Iterator) -> Iterator:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                vectors = part.column(1).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, dim)
                heaps = Heaps([[] for _ in range(k)])
                found = now.scan(vectors, heaps, list(range(part.num_rows)))
                moved = _moves(vectors, np.full(part.num_rows, -1), found, k)
                yield _stored_blocks([_block_row((task << 32) | number, part.column(0).to_pylist(), vectors, heaps, part.num_rows, moved)])
                number += 1

    return kept.mapInArrow(cut, _BLOCK)


def _expired(row: dict, now: _Round, dim: int) -> tuple[np.ndarray, Heaps, list[int], np.ndarray, np.ndarray]:
    """The block's vectors and heaps after its expired rows were scanned; those rows, old and new clusters."""
    vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, dim).astype(np.int64)
    heaps = Heaps.stored(row["heap_rows"], row["heap_keys"], row["heap_sizes"])
    rows, old = heaps.pop(now.drift, now.slack)
    new = now.scan(vectors, heaps, rows) if rows else np.empty(0, np.int64)
    return vectors, heaps, rows, np.array(old, np.int64), new


def _next_assignment(blocks: DataFrame, now: _Round) -> DataFrame:
    k, dim = now.centroids.shape

    def scan(batches: Iterator) -> Iterator:
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                vectors, heaps, rows, old, new = _expired(row, now, dim)
                moved = _moves(vectors[rows], old, new, k) if rows else []
                yield _stored_blocks([_block_row(row["block"], row["ids"], vectors, heaps, len(rows), moved)])

    return blocks.drop("scanned", "moved").mapInArrow(scan, _BLOCK)


def _assigned(blocks: DataFrame, now: _Round) -> DataFrame:
    """(vec_id, cluster, distance) under the last centroids."""
    k, dim = now.centroids.shape

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                vectors, heaps, *_ = _expired(row, now, dim)
                labels = heaps.labels(len(vectors))
                distance = ((vectors - now.centroids[labels]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(labels.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"])

    return blocks.drop("scanned", "moved").mapInArrow(read, _ASSIGNED)


def _add_moves(blocks: DataFrame, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add what the blocks report to the running counts and sums: at most k (dim + 1) numbers reach the driver."""
    reported = blocks.select(F.inline("moved"))
    parts = reported.select("cluster", F.posexplode(F.concat(F.array("n"), F.col("sums"))).alias("place", "value"))
    for cluster, place, value in parts.groupBy("cluster", "place").agg(F.sum("value")).collect():
        if place == 0:
            counts[cluster] += value
        else:
            sums[cluster, place - 1] += value


class Clustering:
    """``assigned`` holds (vec_id, cluster, distance), ``centroids`` the last centers and ``scanned``
    how many vectors each assignment scanned."""

    def __init__(self, assigned: DataFrame, centroids: np.ndarray, scanned: list[int]) -> None:
        self.assigned, self.centroids, self.scanned = assigned, centroids, scanned


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2",
            id_column: str = "vec_id", vector_column: str = "embedding", block_rows: int = BLOCK_ROWS) -> Clustering:
    """Lloyd's rounds over whole-numbered vectors, exact, with heap-ordered bounds."""
    ship_package(embeddings.sparkSession)
    kept = embeddings.select(F.col(id_column).cast("long").alias("vec_id"),
                             whole_components(F.col(vector_column), dim).alias("v")).where("v is not null")
    centroids = first_centroids(kept, k, salt)
    if not len(centroids):
        empty = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(empty, centroids, [])
    now = _Round(centroids, np.zeros(len(centroids)))
    blocks = materialise(_first_assignment(kept, now, block_rows), "cluster-blocks")
    counts, sums, scanned = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), []
    for number in range(rounds):
        _add_moves(blocks, counts, sums)
        scanned.append(blocks.agg(F.sum("scanned")).first()[0])
        means = np.floor_divide(sums, np.maximum(counts, 1)[:, None])
        now = now.after(np.where(counts[:, None] > 0, means, now.centroids))
        if number < rounds - 1:
            blocks = materialise(_next_assignment(blocks, now), "cluster-blocks")
    assigned = materialise(_assigned(blocks, now), "cluster-assigned")
    return Clustering(assigned, now.centroids, scanned)


def with_inertia(found: Clustering) -> DataFrame:
    """Every vector with the distances summed over its cluster and over all, and its centroid's digest.

    The two small sides have one row per cluster.
    """
    spark = found.assigned.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(found.centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    per_cluster = sums.join(F.broadcast(total), F.lit(True)).join(F.broadcast(named), "cluster")
    return found.assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
