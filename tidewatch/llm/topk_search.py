"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

The index holds, per block of vectors, one segment per impact level: the postings (dimension,
vector, value) whose size has a given bit length.  A block of queries reads the segments of a
block of vectors by descending impact and adds them to all its scores at once.  After each
segment a vector's missing part is bounded by Cauchy and Schwarz (length of the query times
length of the vector's unread rest), which gives every score a lower and an upper bound.
Reading stops only when few vectors can still reach the k-th best lower bound, or when nothing
is left; those that can are then scored exactly on their whole vectors.  No score is estimated.

Vectors and queries are spread over blocks by hash; every pair of blocks is one bounded piece
of work, which passes on k rows per query.

Defined results: vectors that are null, or hold null or non-finite components, and rows of null
id take no part; empty vectors score 0; vectors of unequal length are compared on their common
components; repeated rows count once; rows that share a query's id are its own and no
candidates for it; ties go to smaller ids.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

#: Vectors and queries of a block, in expectation; members that may be left when reading stops.
BLOCK, QUERY_BLOCK, LEFT_PER_QUERY = 8192, 512, 64
_EXACT = 1 << 53


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """(vec_id, values): whole-number vectors of the rows that take part, each once."""
    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    x = F.col(vector_column)
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return (vectors.where(F.col(id_column).isNotNull() & x.isNotNull() & ~F.exists(x, bad))
            .select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("values")).distinct())


def _matrix(lists) -> np.ndarray:
    rows = lists.combine_chunks() if hasattr(lists, "combine_chunks") else lists
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [[]]).astype(int)] = rows.flatten().to_numpy()
    return out


def _segments(block):
    """The segments of one block by impact level, and a head (level -1) with its ids."""
    import pyarrow as pa

    ids, values = block["vec_id"].to_numpy(), _matrix(block["values"])
    levels = np.frexp(np.abs(values).astype(float))[1]
    number = block["block"][0].as_py()
    rows = [(number, -1, values.shape[1], ids.tobytes(), b"", b"")]
    for level in range(int(levels.max(initial=0)), 0, -1):
        vector, dimension = np.nonzero(levels == level)
        if len(vector):
            by_dimension = np.lexsort((vector, dimension))
            vector, dimension = vector[by_dimension], dimension[by_dimension]
            rows.append((number, level, values.shape[1], vector.astype(np.int32).tobytes(),
                         dimension.astype(np.int32).tobytes(), values[vector, dimension].tobytes()))
    return pa.table([pa.array(column, kind) for column, kind in zip(
        zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
        names=["block", "level", "width", "vectors", "dimensions", "impacts"])


def build_index(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The stored segments of all vectors, and the number of blocks."""
    blocks = max(1, math.ceil(vectors.count() / BLOCK))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)).cast("int"))
    return materialise(placed.groupBy("block").applyInArrow(
        _segments, "block int, level int, width int, vectors binary, dimensions binary, impacts binary"), "impact-index"), blocks


def _search(_, segments, queries, k: int):
    """The k best vectors of one block for each query of one block."""
    import pyarrow as pa

    out: list[tuple] = []
    if segments.num_rows and queries.num_rows:
        q, query_ids, keys = _matrix(queries["values"]), queries["query_id"].to_numpy(), queries["query_key"].to_numpy()
        parts = sorted(segments.to_pylist(), key=lambda s: -s["level"])
        head = parts.pop()
        ids, width = np.frombuffer(head["vectors"], np.int64), min(head["width"], q.shape[1])
        q = q[:, :width].astype(float)
        scores, whole = np.zeros((len(q), len(ids))), np.zeros((len(ids), width), np.int64)
        postings = []
        for part in parts:
            vector, dimension = np.frombuffer(part["vectors"], np.int32), np.frombuffer(part["dimensions"], np.int32)
            shared = dimension < width
            postings.append((vector[shared], dimension[shared], np.frombuffer(part["impacts"], np.int64)[shared]))
            whole[postings[-1][:2]] = postings[-1][2]
        exact = np.abs(q).max(initial=0) * float(np.abs(whole).max(initial=0)) * max(width, 1) < _EXACT
        rest = (whole.astype(float) ** 2).sum(1)
        lengths = np.sqrt((q ** 2).sum(1))[:, None]
        own = query_ids[:, None] == ids[None, :]
        possible = ~own
        for number, (vector, dimension, impact) in enumerate(postings):
            segment = np.zeros((width, len(ids)))
            segment[dimension, vector] = impact
            scores += q @ segment
            rest = np.maximum(rest - (segment ** 2).sum(0), 0)
            slack = lengths * np.sqrt(rest)[None, :] * (1 + 1e-9) + (1e-6 if number + 1 < len(postings) else 0)
            possible = _reach(scores, slack, own, k)
            if possible.sum() <= LEFT_PER_QUERY * len(q):
                break
        at, member = np.nonzero(possible)
        if exact:
            final = np.concatenate([np.einsum("ij,ij->i", q[at[s:s + 65536]], whole[member[s:s + 65536]].astype(float))
                                    for s in range(0, len(at), 65536)] or [np.empty(0)]).astype(np.int64)
        else:
            final = (q[at].astype(np.int64) * whole[member]).sum(1)
        order = np.lexsort((ids[member], -final, at))
        at, member, final = at[order], member[order], final[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < k
        out = [query_ids[at[keep]], keys[at[keep]], ids[member[keep]], final[keep]]
    names = ["query_id", "query_key", "vec_id", "score"]
    return pa.table([pa.array(column, pa.int64()) for column in out or [[]] * 4], names=names)


def _reach(scores: np.ndarray, slack: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Who may be among the k best: an upper bound that reaches the k-th best lower bound."""
    lower = np.where(own, -np.inf, scores - slack)
    if lower.shape[1] > k:
        kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, -k][:, None]
    else:
        kth = np.full((len(lower), 1), -np.inf)
    return (scores + slack >= kth) & ~own


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all other rows.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = materialise(quantised(vectors, id_column, vector_column), "whole-vectors")
    index, blocks = build_index(rows)
    asked = rows.where(is_query).withColumn("query_key", F.xxhash64("values"))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = asked.select(
        F.col("vec_id").alias("query_id"), "query_key", "values",
        F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(query_blocks)).cast("int").alias("query_block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = index.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    found = dealt.groupBy("block", "query_block").cogroup(asked.groupBy("block", "query_block")).applyInArrow(
        partial(_search, k=k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
