"""The two event producers, batch or stream, and what joins and trims them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions.scalars import first_parenthesised
from tidewatch.session import materialise


def _no_tickers() -> Column:
    return F.array().cast("array<string>")


def _reader(spark: SparkSession, streaming: bool, files_per_trigger: int | None):
    if not streaming:
        return spark.read
    reader = spark.readStream
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


def read_news(spark, path, streaming=False, files_per_trigger=None) -> DataFrame:
    """News items landed as JSON lines."""
    return _reader(spark, streaming, files_per_trigger).schema(schemas.NEWS_ITEM).json(path)


def read_filings(spark, path, streaming=False, files_per_trigger=None) -> DataFrame:
    """Atom entries landed as XML files."""
    reader = _reader(spark, streaming, files_per_trigger).format("xml").option("rowTag", "entry")
    entries = reader.schema(schemas.FILING_ENTRY).load(path)
    return entries.select(
        F.col("id").alias("guid"),
        "title",
        F.col("link._href").alias("link"),
        F.coalesce("published", "updated").alias("published"),
    )


def parse_news(lines: DataFrame, body: str = "value") -> DataFrame:
    """News items held as JSON text in a column; the other columns are kept."""
    item = F.from_json(F.col(body), schemas.NEWS_ITEM)
    return lines.withColumn("_item", item).select(
        *[c for c in lines.columns if c != body], "_item.*"
    )


def normalise_news(items: DataFrame, ingested_at: Column) -> DataFrame:
    return items.select(
        "id",
        F.lit(schemas.NEWS_SOURCE).alias("source"),
        F.coalesce("tickers", _no_tickers()).alias("tickers"),
        "title",
        F.col("article_url").alias("content_url"),
        F.lit(None).cast("string").alias("raw_text"),
        F.col("published_utc").alias("published_at"),
        ingested_at.alias("ingested_at"),
    )


def filing_cik(title: Column | str, tolerant: bool = False) -> Column:
    """CIK text of a filing title.

    Strict: the first parenthesised group as it stands.  Tolerant: the first all-digit
    group, without leading zeros.
    """
    if not tolerant:
        return first_parenthesised(title)
    digits = F.regexp_extract(F.col(title) if isinstance(title, str) else title, r"\(([0-9]+)\)", 1)
    return F.nullif(F.regexp_replace(digits, "^0+(?!$)", ""), F.lit(""))


def with_filing_tickers(filings: DataFrame, companies: DataFrame, tolerant: bool = False) -> DataFrame:
    """Left join on the extracted CIK; a miss gives an empty ticker list.

    Titles without a CIK cannot match: their key is made unique so that the null keys
    of an outer join do not meet in one shuffle partition.
    """
    key = F.coalesce(filing_cik("title", tolerant), F.concat(F.lit("no cik "), F.col("guid")))
    tickers = F.when(F.col("_ticker").isNotNull(), F.array("_ticker")).otherwise(_no_tickers())
    dimension = companies.select(F.col("cik").alias("_cik"), F.col("ticker").alias("_ticker"))
    return (
        filings.withColumn("_key", key)
        .join(dimension, F.col("_key") == F.col("_cik"), "left")
        .withColumn("tickers", tickers)
        .drop("_key", "_cik", "_ticker")
    )


def normalise_filings(filings: DataFrame, companies: DataFrame, ingested_at: Column,
                      tolerant: bool = False) -> DataFrame:
    return with_filing_tickers(filings, companies, tolerant).select(
        F.col("guid").alias("id"),
        F.lit(schemas.FILINGS_SOURCE).alias("source"),
        "tickers",
        "title",
        F.col("link").alias("content_url"),
        F.lit(None).cast("string").alias("raw_text"),
        F.col("published").alias("published_at"),
        ingested_at.alias("ingested_at"),
    )


def split_broken(items: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(readable items, the rest): a line that could not be parsed, or has no id, is set aside."""
    return items.where(F.col(key).isNotNull()), items.where(F.col(key).isNull())


def split_undated(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dated events, quarantine): an item without a readable time is set aside."""
    undated = F.col("published_at").isNull()
    return events.where(~undated), events.where(undated)


def fan_in(*feeds: DataFrame) -> DataFrame:
    """All producers as one event frame (batch or stream)."""
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed)
    return merged


def ingest_counts(events: DataFrame, *batch: str) -> DataFrame:
    return events.groupBy("source", *batch).agg(F.count(F.lit(1)).alias("events"))


def dedupe_events(events: DataFrame, *tie_break: str) -> DataFrame:
    """First arrival per id.  The per-key limit also runs before the shuffle."""
    order = W.partitionBy("id").orderBy("ingested_at", *tie_break)
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def unseen(snapshot: DataFrame, cursors: DataFrame) -> DataFrame:
    """Items above each source's last-seen id, with ``emit_order`` oldest first.

    ``snapshot`` holds (source, pos, id, ...) with pos 0 = newest; ``cursors`` holds
    (source, last_id).  A marker that is null or no longer in the feed releases the
    whole feed again.  The marks, one row per source, are written first: the planner
    then knows their size and need not shuffle the feed by its few sources.
    """
    marks = materialise(
        snapshot.join(cursors.withColumnRenamed("last_id", "id"), ["source", "id"], "left_semi")
        .groupBy("source")
        .agg(F.min("pos").alias("_mark")),
        "marks",
    )
    return (
        snapshot.join(marks, "source", "left")
        .where(F.col("_mark").isNull() | (F.col("pos") < F.col("_mark")))
        .withColumn("emit_order", -F.col("pos"))
        .drop("_mark")
    )


def next_cursors(snapshot: DataFrame, cursors: DataFrame) -> DataFrame:
    """(source, last_id) after the poll: the newest id, or the old one for an empty feed."""
    newest = snapshot.groupBy("source").agg(F.min_by("id", "pos").alias("_newest"))
    return cursors.join(newest, "source", "full").select(
        "source", F.coalesce("_newest", "last_id").alias("last_id")
    )
