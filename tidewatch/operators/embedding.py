"""Text to vectors.  An embedder is a callable ``(frame, key, text) -> (key, vector)``."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[DataFrame, str, str], DataFrame]
HASH_DIM = 256
SLICE_BYTES = 8 << 20
TOKENS_REMEMBERED = 1 << 20


# Byte -> itself for a-z and 0-9, space for the rest (every byte of a non-ASCII letter).
_WORD_BYTES = np.full(256, ord(" "), dtype=np.uint8)
for _byte in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _WORD_BYTES[_byte] = _byte


def _words_only(texts: pa.Array) -> pa.Array:
    """Lower-case texts with a space for every byte that belongs to no token."""
    low = pc.utf8_lower(texts.cast(pa.string()))
    valid, offsets, data = low.buffers()
    if data is None:
        return low
    mapped = _WORD_BYTES[np.frombuffer(data, dtype=np.uint8)]
    return pa.StringArray.from_buffers(len(low), offsets, pa.py_buffer(mapped), valid, offset=low.offset)


class _TermHasher:
    """Token counts per hash bucket for whole Arrow batches of texts."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.known: dict[str, int] = {"": -1}

    def bucket(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= TOKENS_REMEMBERED:
                self.known = {"": -1}
            found = int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % self.dim
            self.known[token] = found
        return found

    def weights(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, weight), the weights of a row having length 1."""
        tokens = pc.split_pattern(_words_only(texts), " ")
        flat = tokens.flatten().dictionary_encode()
        buckets = np.array([self.bucket(t) for t in flat.dictionary.to_pylist()], dtype=np.int64)
        buckets = buckets[flat.indices.to_numpy()]
        rows = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
        used = buckets >= 0
        cells, counts = np.unique(rows[used] * self.dim + buckets[used], return_counts=True)
        row = cells // self.dim
        norms = np.sqrt(np.bincount(row, counts.astype(np.float64) ** 2, minlength=len(texts)))
        return row, cells % self.dim, counts / norms[row]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text; a single text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _over_texts(texts: DataFrame, key: str, text: str, dim: int, emit: Callable, columns: str) -> DataFrame:
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _TermHasher(dim)
        for batch in batches:
            for piece in _slices(batch, 1):
                yield emit(piece.column(0), *hasher.weights(piece.column(1)))

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, {columns}")


def hashed_terms(texts: DataFrame, key: str, text: str, dim: int = HASH_DIM) -> DataFrame:
    """(key, bucket, weight): token counts per hash bucket, L2-normalised per text.

    No shuffle: a text is whole in its row, so it is counted where it was read.
    """

    def emit(keys, row, bucket, weight):
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row)), pa.array(bucket), pa.array(weight)], [key, "bucket", "weight"])

    return _over_texts(texts, key, text, dim, emit, "bucket long, weight double")


def hashing_embedder(dim: int = HASH_DIM) -> Embedder:
    """The default embedder: hashed term counts as a dense unit vector.

    A text without any token has no vector.
    """

    def embed(texts: DataFrame, key: str, text: str) -> DataFrame:
        def emit(keys, row, bucket, weight):
            present, index = np.unique(row, return_inverse=True)
            vectors = np.zeros((len(present), dim), dtype=np.float32)
            vectors[index, bucket] = weight
            offsets = pa.array(np.arange(len(present) + 1) * dim, pa.int32())
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(present)), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))],
                [key, "vector"])

        return _over_texts(texts, key, text, dim, emit, "vector array<float>")

    return embed


def lookup_embedder(vectors: DataFrame, vector_key: str, vector: str) -> Embedder:
    """Vectors computed elsewhere, joined by key."""

    def embed(texts: DataFrame, key: str, text: str) -> DataFrame:
        known = vectors.select(F.col(vector_key).alias(key), F.col(vector).alias("vector"))
        return texts.select(key).join(known, key)

    return embed


def model_embedder(model: Callable[[Sequence[str]], Sequence[Sequence[float] | None]]) -> Embedder:
    """A user model called on batches of texts; None for a text it could not embed."""

    def embed(texts: DataFrame, key: str, text: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({key: batch[key], "vector": list(model(batch[text].tolist()))})

        kind = texts.schema[key].dataType.simpleString()
        return texts.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")

    return embed


def embed_queries(strategies: DataFrame, embedder: Embedder) -> DataFrame:
    """Adds ``query_vector``; every distinct query text is embedded once, no null one.

    Strategies meet their vectors by a digest of the text, which is all that is shuffled of it.
    """
    keyed = strategies.withColumn("_query", F.sha2("query", 256))
    texts = keyed.where("query is not null").groupBy("_query").agg(F.first("query").alias("_text"))
    vectors = embedder(texts, "_query", "_text").withColumnRenamed("vector", "query_vector")
    found = keyed.where("query is not null").join(vectors, "_query", "left")
    return found.unionByName(keyed.where("query is null"), allowMissingColumns=True).drop("_query")
