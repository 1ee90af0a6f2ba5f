"""Content join, outcome of each event, failure isolation and retry schedule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.predicates import long_enough
from tidewatch.functions.scalars import col, retry_delay_ms
from tidewatch.operators.embedding import Embedder
from tidewatch.schemas import RETRY
from tidewatch.session import materialise

# ``fetch(urls) -> (url, text)``: a url it has no page for is simply missing.
Fetcher = Callable[[DataFrame], DataFrame]
ENRICHED, SKIPPED_FETCH, SKIPPED_SHORT, ERROR = "enriched", "skipped_fetch", "skipped_short", "error"


def content_join(events: DataFrame, texts: DataFrame) -> DataFrame:
    """Left join on the article address; ``fetched`` says whether a page was there.

    Events without an address, or whose page is missing, stay.  Null addresses get a
    key of their own, so they do not meet in one partition of the outer join.
    """
    pages = texts.select(F.col("url").alias("_url"), *[c for c in texts.columns if c != "url"])
    key = F.coalesce(F.col("content_url"), F.concat(F.lit("no url "), F.col("id")))
    return (
        events.withColumn("_key", key)
        .join(pages, F.col("_key") == F.col("_url"), "left")
        .withColumn("fetched", F.col("_url").isNotNull())
        .drop("_key", "_url")
    )


def outcome(fetched: Column | str, text: Column | str, vector: Column | str) -> Column:
    """Skips are no failures: the event is still matched.  Only a missing vector is an error."""
    return (
        F.when(~F.coalesce(col(fetched), F.lit(False)), SKIPPED_FETCH)
        .when(~long_enough(text), SKIPPED_SHORT)
        .when(col(vector).isNull(), ERROR)
        .otherwise(ENRICHED)
    )


def enrich(events: DataFrame, fetch: Fetcher, embedder: Embedder) -> DataFrame:
    """Events with ``raw_text``, ``vector`` and ``outcome``.

    Each page some event links to is fetched and embedded once, however many events
    share it; its text is written once, for the embedder and for the join.
    """
    linked = events.where("content_url is not null").select(F.col("content_url").alias("url"))
    texts = materialise(fetch(linked), "texts")
    vectors = embedder(texts.where(long_enough("text")), "url", "text")
    joined = content_join(events.drop("raw_text"), texts.join(vectors, "url", "left"))
    named = joined.withColumnRenamed("text", "raw_text")
    return named.withColumn("outcome", outcome("fetched", "raw_text", "vector")).drop("fetched")


def retry_schedule(failures: DataFrame, policy: dict = RETRY) -> DataFrame:
    """When each failed event may be tried again.

    ``failures`` holds ``attempts`` (failed tries so far, at least 1) and ``failed_at``.
    The wait is drawn by the caller from [min_delay_ms, max_delay_ms]; the schedule uses
    the upper bound.  After max_retries + 1 tries an event is exhausted.
    """
    delay = retry_delay_ms(F.col("attempts") - 1, policy)
    waiting = F.col("attempts") <= policy["max_retries"]
    micros = F.unix_micros("failed_at") + (delay * 1000).cast("long")
    return failures.withColumns({
        "exhausted": ~waiting,
        "min_delay_ms": F.when(waiting, delay * 0.5),
        "max_delay_ms": F.when(waiting, delay),
        "next_attempt_at": F.when(waiting, F.timestamp_micros(micros)),
    })
