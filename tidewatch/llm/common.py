"""Words, shingles and fixed-size filters shared by the operators."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import ship_package

_WORD_BYTES = bytes(
    code + 32 if 65 <= code <= 90 else code if 48 <= code <= 57 or 97 <= code <= 122 or code >= 128 else 32
    for code in range(256))

FILTER_BITS = 1 << 20


#: Whole texts of an Arrow batch: what tasks hold at a time, on both sides, follows this.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches of texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words (ASCII letters, digits and all non-ASCII characters) of UTF-8 text."""
    return text.translate(_WORD_BYTES).split() if text else []


def binary_values(array) -> list:
    """The UTF-8 bytes of an Arrow string column, without decoding."""
    import pyarrow as pa

    return array.cast(pa.large_binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word; equal words share one computation."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    known = {word: digest(word) for word in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words make one run.

    A text without words has no run.
    """
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    width = min(size, len(words))
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for offset in range(width):
        runs = (runs ^ hashes[offset:offset + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return np.unique(runs)


def filter_bits(keys: DataFrame, column: Column, bits: int = FILTER_BITS) -> bytes:
    """A bit set over crc32 of the given string or binary column.

    Its size is fixed whatever the number of keys: at most ``bits / 32`` partial words
    reach the driver.  A filter only spares work; whoever uses it checks the keys exactly.
    """
    slot = F.pmod(F.crc32(column.cast("binary")), F.lit(bits))
    parts = (keys.where(column.isNotNull())
             .select((slot / 32).cast("int").alias("word"),
                     F.expr("1L").alias("one"), F.pmod(slot, F.lit(32)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("mask")))
    table = np.zeros(bits // 32, np.uint32)
    rows = parts.toArrow()
    table[rows["word"].to_numpy()] = rows["mask"].to_numpy().astype(np.uint32)
    return table.tobytes()


class Admitted(dict):
    """``admitted[key]``: whether a key may be in the filter; remembers recent keys."""

    REMEMBERED = 200_000

    def __init__(self, bits: bytes):
        super().__init__()
        self.table, self.size = bits, len(bits) * 8

    def __missing__(self, key: bytes) -> bool:
        if len(self) >= self.REMEMBERED:
            self.clear()
        slot = zlib.crc32(key) % self.size
        found = self[key] = bool(self.table[slot >> 3] >> (slot & 7) & 1)
        return found


def sliced(batches: Iterable, rows: int = BATCH_ROWS):
    """The batches in slices of few rows, so that what is made from one stays small in any session."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def keyed_rows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, doc_id, text_key): whole rows beside the key of their document, whatever their columns are called.

    ``text_key`` tells apart rows of one id whose texts differ; ``row.*`` gives the rows back.
    """
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
                            F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(F.col(text_column).cast("string")).alias("text_key"))


def same_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join of two frames with (doc_id, text_key) on that key, null ids included; the left key stays."""
    other = right.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    joined = left.join(other, left.doc_id.eqNullSafe(other["_doc"]) & (left.text_key == other["_key"]), how)
    return joined if how in ("left_anti", "left_semi") else joined.drop("_doc", "_key")


def record_batches(names: Iterable[str], types: Iterable, columns: list[list], rows: int = 20_000):
    """Arrow batches of bounded length from column lists."""
    import pyarrow as pa

    schema = pa.schema(list(zip(names, types, strict=True)))
    for start in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays(
            [pa.array(values[start:start + rows], kind.type) for values, kind in zip(columns, schema, strict=True)],
            schema=schema)
