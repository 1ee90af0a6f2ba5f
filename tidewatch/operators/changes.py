"""A change feed of table maintenance: every insert, update and delete as a typed row.

A change holds the row before and after, and the version of the maintenance step that made it.
Replaying a feed onto the old table gives the new one, whatever part of the feed was seen twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.corpus import latest_per_key

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _row(frame: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias(name)


def changes(before: DataFrame, after: DataFrame, key: str, version: int) -> DataFrame:
    """(key, version, kind, old, new) of every row that one step changed.

    Both tables need unique keys.  Rows are compared whole, null-safe; a column that one side
    lacks is null there.
    """
    columns = [*before.columns, *[c for c in after.columns if c not in before.columns]]
    old, new = (frame.select(*[F.col(c) if c in frame.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in columns])
                for frame, other in ((before, after), (after, before)))
    left = old.select(F.col(key).alias("key"), _row(old, "old"))
    right = new.select(F.col(key).alias("key"), _row(new, "new"))
    kind = F.when(F.col("old").isNull(), INSERT).when(F.col("new").isNull(), DELETE).otherwise(UPDATE)
    met = left.join(right, "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return met.select("key", F.lit(version).cast("long").alias("version"), kind.alias("kind"), "old", "new")


def fields_changed(feed: DataFrame) -> DataFrame:
    """(key, version, kind, field): which fields each change touches; all of them for inserts and deletes."""
    names = feed.schema["new"].dataType.names
    touched = F.array_compact(F.array(*[
        F.when(~F.col("old").getField(n).eqNullSafe(F.col("new").getField(n)) | (F.col("kind") != UPDATE), F.lit(n)) for n in names]))
    return feed.select("key", "version", "kind", F.explode(touched).alias("field"))


def replay(table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The table after all changes: per key the one of the highest version decides."""
    last = latest_per_key(feed.select("key", "version", "kind", "new"), ["key"], F.col("version").desc())
    kept = table.join(last.select(F.col("key").alias(key)), key, "left_anti")
    written = last.where(F.col("kind") != DELETE).select("new.*")
    return kept.unionByName(written, allowMissingColumns=True)


def undo(table: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """The table before all changes of the feed: per key the one of the lowest version decides."""
    first = latest_per_key(feed.select("key", "version", "kind", "old"), ["key"], F.col("version").asc())
    kept = table.join(first.select(F.col("key").alias(key)), key, "left_anti")
    return kept.unionByName(first.where(F.col("kind") != INSERT).select("old.*"), allowMissingColumns=True)
