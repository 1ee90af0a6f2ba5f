"""Registered queries: name -> callable (spark, sf_dir) -> DataFrame.

Arrays leave as joined text and times as RFC 3339 text, so that results compare by value.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import predicates as P
from tidewatch.functions import scalars as X
from tidewatch.functions import secrets
from tidewatch.operators import alerts as A
from tidewatch.operators import corpus as C
from tidewatch.operators import (
    cells, changes, counters, embedding, enrichment, matching, partlog, predicate_index, ranking, scoring, sinks, tables,
)
from tidewatch.plans import bindings as B
from tidewatch.schemas import ALERT, EVENT
from tidewatch.session import materialise, read_parts, scratch_path
from tidewatch.sources import companies, feeds, pages, polls, registry
from tidewatch.streaming import counters as stored
from tidewatch.streaming import feeds as live
from tidewatch.streaming import ingest, matcher, registry_stream, retry
from tidewatch.streaming.job import FAILURE, OUTCOME, EventJob

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = "0123456789abcdef0123456789abcdef"
SMALL_BLOCK = 200_000  # bytes, so that the given registry makes several blocks


def query(build: Callable[[B.Tables], DataFrame]) -> Callable[[B.Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(B.Tables(spark, sf_dir))
    return build


def joined(name: str):
    return F.array_join(name, "|").alias(name)


def long(value):
    return F.col(value).cast("bigint").alias(value) if isinstance(value, str) else value.cast("bigint")


def time(name: str):
    return X.rfc3339(name).alias(name)


# -- sources ---------------------------------------------------------------------


def _event_view(events: DataFrame) -> DataFrame:
    return events.select("id", "source", joined("tickers"), "title", "content_url",
                         time("published_at"), time("ingested_at"))


def _news(t: B.Tables) -> DataFrame:
    readable, _ = feeds.split_broken(feeds.parse_news(t.news_lines()))
    return feeds.normalise_news(readable, F.col("ingested_at"))


def _filings(t: B.Tables, tolerant: bool = False) -> DataFrame:
    known = companies.company_tickers(t.company_documents())
    return feeds.normalise_filings(t.filings(), known, F.col("published") + B.minute(), tolerant)


@query
def ingest_news(t):
    return _event_view(_news(t).withColumn("ingested_at", F.col("published_at") + B.minute()))


@query
def ingest_filings(t):
    dated, _ = feeds.split_undated(_filings(t))
    return _event_view(dated)


@query
def company_tickers(t):
    return companies.company_tickers(t.company_documents())


@query
def filing_tickers(t):
    return _filings(t).select("id", joined("tickers"))


@query
def filing_tickers_tolerant(t):
    return _filings(t, tolerant=True).select("id", joined("tickers"))


@query
def fan_in(t):
    return feeds.fan_in(_news(t), _filings(t)).select("id", "source", "title", time("published_at"))


@query
def ingest_counts(t):
    polled = feeds.fan_in(_news(t), _filings(t)).withColumn("poll", F.date_format("published_at", "yyyy-MM"))
    return feeds.ingest_counts(polled, "poll")


@query
def dedupe_events(t):
    return feeds.dedupe_events(t.with_repeats(), "title").select("id", "title", time("ingested_at"))


def _snapshot(t: B.Tables) -> tuple[DataFrame, DataFrame]:
    """Two newest-first feeds: one with its marker at 30 % depth, one whose marker is gone."""
    def feed(name: str, table: str, key: str):
        rows = t.raw(table)
        newest = rows.agg(F.max(key)).scalar()
        total = rows.agg(F.count(F.lit(1))).scalar()
        items = rows.select(F.lit(name).alias("source"), F.col(key).cast("string").alias("id"),
                            (newest - F.col(key)).alias("pos"))
        return items, rows.agg((F.max(key) - F.floor(F.count(F.lit(1)) * 0.3)).cast("string").alias("last_id"))

    news, mark = feed("news", "events", "event_id")
    filings, _ = feed("filings", "orders", "o_orderkey")
    marks = mark.select(F.lit("news").alias("source"), "last_id")
    gone = marks.select(F.lit("filings").alias("source"), F.lit("gone").alias("last_id"))
    return news.unionByName(filings), marks.unionByName(gone)


@query
def new_since_cursor(t):
    snapshot, cursors = _snapshot(t)
    return feeds.unseen(snapshot, cursors).select("source", "id", long("emit_order"))


@query
def next_cursors(t):
    return feeds.next_cursors(*_snapshot(t))


@query
def import_strategies(t):
    accepted, rejected = registry.import_strategies(t.strategy_requests(), B.now())
    view = accepted.select(
        "request_id", F.lit("ok").alias("status"), "id", "user_id", "name", "query", joined("source"),
        joined("tickers"), "similarity_threshold", "is_active", time("created_at"))
    return view.unionByName(rejected.select("request_id", "status", "user_id"), allowMissingColumns=True)


# -- filters and joins ------------------------------------------------------------


def _plain_interests(t: B.Tables) -> DataFrame:
    return matching.interests(t.active())


def _plain_arrivals(t: B.Tables) -> DataFrame:
    return matching.arrivals(t.events(url=False, vector=False))


@query
def active_strategies(t):
    return t.active().select("id", "user_id", "owner_email", "name", "query", joined("source"),
                             joined("tickers"), "similarity_threshold")


@query
def filter_source(t):
    return matching.count_by_source(_plain_arrivals(t), _plain_interests(t))


@query
def filter_tickers(t):
    return matching.count_by_tickers(_plain_arrivals(t), _plain_interests(t))


@query
def prefilter_match(t):
    pairs = matching.prefilter_join(_plain_arrivals(t), _plain_interests(t))
    return pairs.select("event_id", "strategy_id")


@query
def prefilter_match_equi(t):
    pairs = matching.prefilter_join(_plain_arrivals(t), _plain_interests(t), salts=matching.SALTS)
    return pairs.select("event_id", "strategy_id")


@query
def strategies_checked(t):
    return matching.strategies_checked(_plain_arrivals(t), t.active())


@query
def strategies_passed(t):
    pairs = matching.prefilter_join(_plain_arrivals(t), matching.alike(_plain_interests(t)))
    return matching.strategies_passed(pairs)


@query
def min_text_filter(t):
    kept = t.raw("documents").where(P.long_enough("text"))
    return kept.select("doc_id", long(F.octet_length("text")).alias("n_bytes"))


@query
def owner_scoped_read(t):
    rows = t.strategies()
    asked = rows.select("id", F.when(F.col("seq") % 2 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"))
    return tables.owner_scoped_read(rows, asked).select("id", "user_id", "name")


@query
def content_join(t):
    crawled = t.raw("pages").withColumn("html_bytes", F.octet_length("html")).select("url", "html_bytes")
    found = enrichment.content_join(t.events(vector=False), crawled)
    return found.select("id", "content_url", "fetched", long("html_bytes"))


# -- vectors ------------------------------------------------------------------------


@query
def point_ids(t):
    return t.raw("documents").select("doc_id", X.uuid5_nil(F.col("doc_id").cast("string")).alias("point_id"))


@query
def point_payload(t):
    return C.payload(t.events(vector=False)).select(
        "id", F.col("payload.source").alias("source"), F.col("payload.title").alias("title"),
        F.col("payload.content_url").alias("content_url"), F.col("payload.published_at").alias("published_at"),
        F.array_join("payload.tickers", "|").alias("tickers"))


@query
def corpus_stats(t):
    return C.corpus_stats(C.to_points(t.enriched(url=True)), "Cosine")


@query
def vector_schema_guard(t):
    """Every thirteenth vector is one number short, every seventeenth is missing."""
    short = F.when(F.col("seq") % 13 == 0, F.slice("vector", 1, B.DIM - 1)).otherwise(F.col("vector"))
    damaged = t.events(url=False).withColumn("vector", F.when(F.col("seq") % 17 != 3, short))
    return C.guard_vectors(damaged, B.DIM).select("id", "vector_status")


@query
def upsert_points(t):
    """Into a corpus that holds every second point already, a fourth of them with a later time."""
    points = C.to_points(t.with_repeats().withColumn("content_url", F.lit(None).cast("string")))
    old = t.events(url=False).where("seq % 2 = 0").withColumns({
        "content_url": F.lit(None).cast("string"), "title": F.lit("stored before"),
        "ingested_at": F.col("ingested_at") + F.when(F.col("seq") % 8 == 0, F.expr("interval 9 days")).otherwise(F.expr("interval 0 days"))})
    merged = C.upsert_points(C.to_points(old), points.where(F.col("event_id").cast("long") % 10 != 4))
    return merged.select("point_id", "event_id", F.col("payload.title").alias("title"),
                         F.array_join("payload.tickers", "|").alias("tickers"), time("version"))


@query
def cosine_scores(t):
    return scoring.score_pairs(t.arrivals(), t.interests())


@query
def embed_text(t):
    terms = embedding.hashed_terms(t.raw("documents"), "doc_id", "text")
    return terms.select("doc_id", long("bucket"), F.round("weight", 9).alias("weight"))


@query
def embed_queries(t):
    strategies = t.strategies().drop("query_vector")
    vectors = embedding.embed_queries(strategies, embedding.hashing_embedder())
    terms = vectors.select("id", F.posexplode("query_vector").alias("bucket", "weight")).where("weight > 0")
    return terms.select("id", long("bucket"), F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query
def vector_search(t):
    hits = ranking.vector_search(t.corpus(), t.interests())
    return hits.select("strategy_id", "point_id", "score", long("rank"))


@query
def vector_search_large_registry(t):
    hits = ranking.vector_search(t.corpus(), t.interests(), max_block_bytes=SMALL_BLOCK)
    return hits.select("strategy_id", "point_id", "score", long("rank"))


@query
def vector_search_lsh(t):
    hits = ranking.vector_search(t.corpus(), t.interests(), method="lsh")
    return hits.select("strategy_id", "point_id", "score", long("rank"))


# -- matches and alerts ---------------------------------------------------------------


@query
def match_alerts(t):
    found = ranking.match_at_arrival(t.arrivals(), t.interests())
    return found.select("strategy_id", "event_id", "score", long("rank"))


@query
def match_alerts_single_precision(t):
    """Thresholds of 1, met by the strategies' own vectors, and of 0.1, by scores as single-precision numbers."""
    wanted = t.interests().withColumn("threshold", F.when(F.col("strategy_id").cast("long") % 3 == 0, 1.0).otherwise(F.lit(0.1)))
    found = ranking.match_at_arrival(t.arrivals(), wanted, single_precision=True)
    return found.select("strategy_id", "event_id", "score", long("rank"))


@query
def match_alerts_large_registry(t):
    found = ranking.match_at_arrival(t.arrivals(), t.interests(), max_block_bytes=SMALL_BLOCK)
    return found.select("strategy_id", "event_id", "score", long("rank"))


@query
def match_alerts_final(t):
    hits = ranking.vector_search(t.corpus(), t.interests())
    events = t.corpus().select("point_id", "event_id")
    found = ranking.match_in_corpus(hits, events, t.interests())
    return found.select("strategy_id", "event_id", "score", long("rank"))


def _messages(t: B.Tables) -> DataFrame:
    found = ranking.match_at_arrival(t.arrivals(), t.interests())
    return A.alert_messages(found, t.events(vector=False), t.active())


def _alerts(t: B.Tables) -> DataFrame:
    return A.alert_rows(_messages(t), F.col("ingested_at"))


@query
def alert_rows(t):
    return _alerts(t).withColumn("created_at", X.rfc3339("created_at"))


@query
def alert_log(t):
    return A.alert_log(_messages(t))


@query
def user_alert_feed(t):
    return A.user_feed(_alerts(t)).select("user_id", long("seq"), "payload")


@query
def user_alerts_page(t):
    return A.user_alerts_page(_alerts(t), "3", limit=50, offset=20).select("id", "user_id", time("created_at"))


@query
def alert_pages(t):
    return A.alert_pages(_alerts(t)).select("id", "user_id", long("position"))


@query
def alert_badges(t):
    return A.alert_badges(_alerts(t)).select("id", "label", "colour", "unread")


@query
def strategy_cards(t):
    return A.strategy_cards(t.strategies()).select("id", "state", "action", "sources_label", "tickers_label")


@query
def event_counters(t):
    return counters.run_counters(t.outcomes(), ranking.match_at_arrival(t.arrivals(), t.interests()))


# -- enrichment ----------------------------------------------------------------------


@query
def enrichment_outcomes(t):
    return t.outcomes().select("id", "outcome", long("failed_calls"))


@query
def retry_schedule(t):
    failures = t.outcomes().where("outcome = 'error'").select(
        "id", (F.col("seq") % 4 + 1).cast("int").alias("attempts"), F.col("ingested_at").alias("failed_at"))
    due = F.unix_micros("next_attempt_at") - F.unix_micros("failed_at")
    return enrichment.retry_schedule(failures).select(
        "id", long("attempts"), "exhausted", "min_delay_ms", "max_delay_ms", long(due).alias("wait_micros"))


@query
def extract_text(t):
    return pages.extract_text(t.raw("pages"))


@query
def enrich_events(t):
    fetch = pages.page_fetcher(t.raw("pages"))
    done = enrichment.enrich(t.events(vector=False), fetch, embedding.hashing_embedder())
    return done.select("id", "outcome", long(F.size("vector")).alias("dims"))


@query
def pipeline_alerts(t):
    """Pages to alerts over every document: text, embedding, upsert into a corpus that holds every
    second point with an outdated vector, query embedding, search, threshold."""
    address = F.concat(F.lit("https://docs.example/"), F.col("doc_id"))
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><body><nav>menu</nav><article><p>"), escaped, F.lit("</p></article></body></html>"))
    crawled = t.raw("documents").select(address.alias("url"), html.alias("html"))
    events = t.events(url=False, vector=False).withColumn("content_url", F.concat(F.lit("https://docs.example/"), "id"))
    done = enrichment.enrich(events, pages.page_fetcher(crawled), embedding.hashing_embedder())
    points = materialise(C.to_points(done.where(F.col("outcome") == enrichment.ENRICHED)), "points")
    outdated = points.where(F.col("event_id").cast("long") % 2 == 0).withColumn("vector", F.reverse("vector"))
    corpus = materialise(C.upsert_points(outdated, points), "corpus")
    embedded = embedding.embed_queries(t.active().drop("query_vector"), embedding.hashing_embedder())
    wanted = materialise(matching.interests(embedded, "query_vector"), "interests")
    hits = ranking.vector_search(C.searchable(corpus), wanted)
    found = ranking.match_in_corpus(hits, corpus.select("point_id", "event_id"), wanted)
    return found.select("strategy_id", "event_id", "score", long("rank"))


@query
def parse_tickers(t):
    typed = F.concat_ws(" ,", "lang", F.concat(F.lit("t"), F.col("doc_id") % 10), F.lit(" "), "source")
    return t.raw("documents").select("doc_id", F.array_join(X.parse_tickers(typed), "|").alias("tickers"))


# -- table maintenance ------------------------------------------------------------------


@query
def user_strategies(t):
    return tables.user_strategies(t.strategies(), "3").select("id", "name", time("created_at"))


@query
def toggle_strategies(t):
    rows = t.strategies()
    asked = rows.where("seq % 7 = 0").select("id", "user_id")
    twice = rows.where("seq % 21 = 0").select("id", "user_id")
    return tables.toggle_strategies(rows, asked.unionByName(twice), B.now()).select(
        "id", "is_active", time("updated_at"))


@query
def update_strategies(t):
    rows = t.strategies().drop("query_vector")
    first = rows.where("seq % 4 = 0").withColumns({
        "name": F.concat(F.lit("renamed "), "seq"), "similarity_threshold": F.lit(0.75), "version": F.lit(1),
        "user_id": F.when(F.col("seq") % 3 == 0, "stranger").otherwise(F.col("user_id"))})
    second = first.where("seq % 8 = 0").withColumns({
        "name": F.concat(F.lit("renamed again "), "seq"), "is_active": ~F.col("is_active"), "version": F.lit(2)})
    return tables.update_strategies(rows, first.unionByName(second), B.now(), "version").select(
        "id", "name", "similarity_threshold", "is_active", time("updated_at"))


def _read_requests(alerts: DataFrame) -> DataFrame:
    """Half of the requests come from the wrong user."""
    event = F.col("event_id").cast("bigint")
    owner = F.when(event % 2 == 0, F.col("user_id")).otherwise("stranger")
    return alerts.where(event % 5 == 0).select("id", owner.alias("user_id"))


@query
def mark_alerts_read(t):
    rows = materialise(_alerts(t), "alerts")
    return tables.mark_alerts_read(rows, _read_requests(rows)).select("id", "user_id", "is_read")


@query
def mark_alerts_not_found(t):
    rows = materialise(_alerts(t), "alerts")
    return tables.not_found(rows, _read_requests(rows))


@query
def delete_strategies(t):
    rows = t.strategies()
    return tables.delete_strategies(rows, rows.where("seq % 9 = 0")).select("id", "user_id")


@query
def delete_strategies_alerts(t):
    rows = t.strategies()
    left = tables.unlink_alerts(_alerts(t), rows, rows.where("seq % 9 = 0"))
    return left.select("id", "strategy_id")


@query
def cascade_delete_users(t):
    users = t.users()
    gone = users.where("seq % 6 = 0")
    left = tables.cascade_delete_users(users, gone, t.keys(), t.strategies(), _alerts(t))
    names = ("users", "api_keys", "strategies", "alerts")
    parts = [rows.select(F.lit(name).alias("kept_in"), "id") for name, rows in zip(names, left)]
    return feeds.fan_in(*parts)


@query
def upsert_api_keys(t):
    return tables.upsert_api_keys(t.keys(), t.key_requests()).withColumn("created_at", X.rfc3339("created_at"))


@query
def delete_api_keys(t):
    asked = t.key_requests().where("seq % 3 = 0")
    return tables.delete_api_keys(t.keys(), asked).select("id", "user_id", "provider")


@query
def key_status(t):
    return tables.key_status(t.users(), tables.upsert_api_keys(t.keys(), t.key_requests()))


@query
def register_users(t):
    existing = t.users().where("seq % 5 = 0")
    inserted, rejected = tables.register_users(existing, t.user_requests(), "seq")
    return inserted.select("email", "seq", F.lit("inserted").alias("status")).unionByName(
        rejected.select("email", "seq", F.lit("rejected").alias("status")))


@query
def unique_violations(t):
    return tables.unique_violations(t.user_requests(), "email")


@query
def encrypt_column(t):
    sealed = secrets.encrypt(F.col("encrypted_key"), KEY)
    rows = t.key_requests().withColumn("sealed", sealed)
    size = long(F.octet_length(F.unbase64("sealed")))  # the sealed text itself differs from run to run
    return rows.select("user_id", "provider", "encrypted_key", size.alias("sealed_bytes"))


@query
def decrypt_column(t):
    """Round trip; every seventh stored value is damaged, every eleventh sealed with another key."""
    other = KEY[::-1]
    sealed = F.when(F.col("seq") % 11 == 0, secrets.encrypt("encrypted_key", other)).otherwise(
        secrets.encrypt("encrypted_key", KEY))
    damaged = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("AAAA"), F.expr("substr(sealed, 5)"))).otherwise(
        F.col("sealed"))
    stored = t.key_requests().withColumn("sealed", sealed).withColumn("sealed", damaged)
    opened = stored.withColumn("opened", secrets.decrypt("sealed", KEY))
    return opened.select("user_id", time("created_at"), "opened", F.col("opened").isNull().alias("rejected"))


# -- streams ---------------------------------------------------------------------------


FILES = 4  # of a landed step, so that a micro-batch has several tasks


def _land(rows: DataFrame, name: str, steps: int = 3) -> str:
    """Write rows as successive steps in order of arrival, each of ``FILES`` files."""
    path = scratch_path(rows.sparkSession, name)
    last = rows.agg(F.max("seq")).first()[0]
    rows = materialise(rows.withColumn("_step", F.floor(F.col("seq") * steps / (last + 1)).cast("int")), name)
    for number in range(steps):
        rows.where(F.col("_step") == number).drop("_step").repartition(FILES).write.mode("append").parquet(path)
    return path


def _drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything landed so far and read what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    run = (
        stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "progress"))
        .trigger(availableNow=True).start(out)
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_match_alerts(t):
    landed = matching.arrivals(t.enriched(), "ingested_at", "vector", "seq")
    path = _land(landed, "arrivals")
    arriving = ingest.read_events(t.spark, path, landed.schema, files_per_trigger=FILES)
    found = _drain(matcher.stream_matches(arriving, t.interests()), "matches")
    return found.select("strategy_id", "event_id", "score", long("rank"))


@query
def stream_registry_changes(t):
    """Edits arrive beside the events: from the middle of the time on, every tenth strategy is switched
    off and every tenth asks for more."""
    landed = materialise(matching.arrivals(t.enriched(), "ingested_at", "vector"), "arrivals")
    half = F.expr("timestamp_micros((unix_micros(min(ingested_at)) + unix_micros(max(ingested_at))) div 2)")
    middle = F.lit(landed.agg(half).first()[0])
    path = scratch_path(t.spark, "arrivals")
    for part in (F.col("ingested_at") < middle, F.col("ingested_at") >= middle):
        landed.where(part).repartition(FILES).write.mode("append").parquet(path)
    registry = t.active()
    turn = F.col("seq") % 10
    edited = registry.where(turn.isin(1, 2)).withColumns({
        "is_active": turn != 1, "similarity_threshold": F.when(turn == 2, 0.5).otherwise(F.col("similarity_threshold"))})
    feed, changes = scratch_path(t.spark, "edits"), registry_stream.edits(edited, middle)
    changes.repartition(FILES).write.parquet(feed)  # all in the first micro-batch, in force from their time on
    found = registry_stream.stream_matches(
        ingest.read_events(t.spark, path, landed.schema, files_per_trigger=FILES),
        ingest.read_events(t.spark, feed, changes.schema, files_per_trigger=FILES),
        registry_stream.edits(registry, F.lit(None).cast("timestamp")), shards=8)
    return _drain(found, "matches").select("strategy_id", "event_id", "score", long("rank"))


@query
def stream_dedupe_events(t):
    landed = t.with_repeats().drop("vector")
    path = _land(landed, "repeats")
    arriving = ingest.read_events(t.spark, path, landed.schema, files_per_trigger=FILES)
    return _drain(ingest.dedupe_stream(arriving), "deduped").select("id", "source")


@query
def stream_event_job(t):
    """Alerts of the whole job: dedupe, enrich, store, match, notify, in three micro-batches."""
    spark = t.spark
    root = scratch_path(spark, "job")
    landed = t.events().select(*EVENT.names, "seq")
    vectors = materialise(t.vectors().select(F.col("seq").cast("string").alias("id"), "vector"), "vectors")

    def enrich(events: DataFrame) -> DataFrame:
        state = enrichment.outcome(F.lit(True), "raw_text", "vector")
        return events.join(vectors, "id", "left").withColumn("outcome", state)

    job = EventJob(spark, root, t.active, enrich, [sinks.table_sink(f"{root}/alerts", F.col("ingested_at"))])
    arriving = ingest.read_events(spark, _land(landed, "events"), landed.schema, files_per_trigger=FILES)
    job.start(ingest.dedupe_stream(arriving), scratch_path(spark, "progress"), availableNow=True).awaitTermination()
    return sinks.read_alerts(spark, f"{root}/alerts").withColumn("created_at", X.rfc3339("created_at"))


@query
def stream_retry_outcomes(t):
    """What becomes of failures: every fifth event fails once, a sink always fails, and the first
    step is delivered again at the end, so that the last micro-batch has no rows.  The failures of
    the third step then still wait."""
    spark = t.spark
    root = scratch_path(spark, "retries")
    landed = t.events(url=False, vector=False).withColumn("content_url", F.lit(None).cast("string")).select(*EVENT.names, "seq")
    unit = F.array(F.lit(1.0).cast("float"))

    def enrich(events: DataFrame) -> DataFrame:
        fails = (F.col("id").cast("long") % 5 == 0) & (F.col("attempts") == 0)
        tried = events.withColumn("vector", F.when(~fails, unit))
        return tried.withColumn("outcome", enrichment.outcome(F.lit(True), "raw_text", "vector"))

    def broken(messages: DataFrame, batch_id: int) -> None:
        raise OSError("a sink that is down")

    path = _land(landed, "events")
    step = F.floor(F.col("seq") * 3 / (landed.agg(F.max("seq")).first()[0] + 1))
    landed.where(step == 0).repartition(FILES).write.mode("append").parquet(path)
    job = EventJob(spark, root, lambda: t.active().withColumn("query_vector", unit), enrich, [broken])
    arriving = ingest.read_events(spark, path, landed.schema, files_per_trigger=FILES)
    job.start(ingest.dedupe_stream(arriving), scratch_path(spark, "progress"), availableNow=True).awaitTermination()
    handled = read_parts(spark, job.path("outcomes"), OUTCOME).select("id", "outcome", long("attempts"))
    last = read_parts(spark, job.path("failures"), FAILURE).where("batch = 3")
    return handled.unionByName(last.select("id", F.lit("waiting").alias("outcome"), long("attempts")))


@query
def stream_cursor_polls(t):
    """Polls of two feeds, with a restart in the middle.  Before it: the older 70 % of one feed, a poll
    of it whose newest item is broken, and a filing that is gone later.  After it: both feeds whole."""
    spark = t.spark
    root, out, progress = (scratch_path(spark, name) for name in ("polls", "polled", "progress"))

    def feed(table: str, key: str) -> DataFrame:
        return t.raw(table).select(F.col(key).alias("key"), F.to_json(F.struct(F.col(key).cast("string").alias("id"))).alias("body"))

    def land(rows: DataFrame, source: str, poll: int) -> None:
        polls.land_poll(rows.withColumn("pos", -F.col("key")), root, source, poll)

    def drain() -> None:
        polled = polls.poll_stream(spark, root, cursor=f"{progress}/cursor.json")
        polled.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()

    news, filings = feed("events", "event_id"), feed("orders", "o_orderkey")
    newest, total = news.agg(F.max("key"), F.count(F.lit(1))).first()
    land(news.where(F.col("key") <= newest - int(total * 0.3)), "news", 0)
    land(news.withColumn("body", F.when(F.col("key") == newest, "{broken").otherwise(F.col("body"))), "news", 1)
    land(spark.createDataFrame([(0, '{"id": "gone"}')], "key long, body string"), "filings", 0)
    drain()
    land(news, "news", 2)
    land(filings, "filings", 1)
    drain()
    return spark.read.schema(polls.SCHEMA).parquet(out).select(
        "source", "poll", "id", (-F.col("pos")).alias("emit_order"), F.col("error").isNotNull().alias("discarded"))


@query
def stream_retry_timers(t):
    """Every document once, then silence: its first doc_id % 6 tries fail, and timers bring the others."""
    spark = t.spark
    path, out = scratch_path(spark, "failing"), scratch_path(spark, "retried")
    landed = t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("body"))
    landed.write.parquet(path)

    def attempt(key: str, body: str, tries: int) -> str:
        if tries < int(body) % 6:
            raise OSError("not yet")
        return f"value {key}"

    arriving = ingest.read_events(spark, path, landed.schema)
    run = (retry.with_retries(arriving, attempt).writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "progress"))
           .trigger(processingTime="500 milliseconds").start(out))
    expected, done = landed.count(), 0
    try:
        while run.isActive and done < expected:
            clock.sleep(0.5)
            done = read_parts(spark, out, retry_outcome()).count()
    finally:
        run.stop()
    if run.exception():
        raise run.exception()
    return read_parts(spark, out, retry_outcome()).select("id", "outcome", long("tries"), "value")


def retry_outcome():
    return T.StructType.fromDDL(retry.OUTCOME)


@query
def stream_live_feed(t):
    """Alerts in three steps; after the first two steps every subscriber takes some of what waits."""
    spark = t.spark
    path, out, progress = (scratch_path(spark, name) for name in ("feed", "fed", "progress"))
    rows = materialise(_alerts(t), "alerts")
    event = F.col("event_id").cast("long")
    last = t.raw("documents").agg(F.max("doc_id")).scalar()
    step = F.floor(event * 3 / (last + 1))
    users = rows.select("user_id").distinct()
    end = rows.agg(F.max("created_at")).scalar()

    def takes(n) -> DataFrame:
        return users.select("user_id", end.alias("at"), F.lit(live.TAKE).alias("kind"), F.lit(None).cast("string").alias("id"),
                            F.lit(None).cast("string").alias("payload"), n.cast("int").alias("n"))

    some = F.col("user_id").cast("long") % 5 * 10
    steps = [rows.where(step == 0), takes(some), rows.where(step == 1), takes(F.lit(40)), rows.where(step == 2)]
    for entries in steps:
        entries = live.alert_entries(entries) if "kind" not in entries.columns else entries
        entries.write.mode("append").parquet(path)
        arriving = spark.readStream.schema(entries.schema).parquet(path)
        (live.live_feed(arriving).writeStream.format("parquet").option("checkpointLocation", progress)
         .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.schema(live.FEED).parquet(out).select("user_id", "id", "status", "seq")


# -- classes, cells, logs of parts, change feeds -----------------------------------------


@query
def prefilter_match_classes(t):
    return predicate_index.prefilter_pairs(_plain_arrivals(t), _plain_interests(t))


@query
def strategies_passed_classes(t):
    return predicate_index.strategies_passed(_plain_arrivals(t), _plain_interests(t))


@query
def vector_search_cells(t):
    found = cells.search_cells(cells.build_cells(t.corpus()), t.interests())
    return found.hits.select("strategy_id", "point_id", "score", long("rank"))


@query
def corpus_versions(t):
    """The corpus as readers of each version see it: three commits, a compaction, a late commit."""
    log = C.point_log(t.spark, scratch_path(t.spark, "corpus"))
    rows = materialise(t.events(url=False).withColumn("content_url", F.lit(None).cast("string")), "events")

    def titled(title: str, where: str):
        return C.to_points(rows.where(where).withColumn("title", F.lit(title)))

    for batch, points in enumerate([titled("stored before", "seq % 2 = 0"), titled("first", "seq % 3 <> 1"), titled("again", "seq % 6 = 0")]):
        C.commit_points(log, points, batch)
    log.compact(C.newest_points, before=3, force=True)
    C.commit_points(log, titled("late", "seq % 10 = 4"), 3)
    views = [C.newest_points(log.read(version)).select(F.lit(version).cast("long").alias("version"), "point_id", "event_id", F.col("payload.title").alias("title"))
             for version in log.versions()]
    return feeds.fan_in(*views)


@query
def user_alerts_page_skipping(t):
    """One owner's page from a log of parts clustered by owner: only files that may hold the owner are opened."""
    log = partlog.PartLog(t.spark, scratch_path(t.spark, "alerts"), ALERT, ("user_id",))
    rows = materialise(_alerts(t), "alerts")
    for batch in range(3):
        log.commit(rows.where(F.col("event_id").cast("long") % 3 == batch), batch)
    log.compact(lambda parts: parts, before=3, files=8, force=True)
    return A.user_alerts_page(log.read(where={"user_id": "3"}), "3", limit=50, offset=20).select("id", "user_id", time("created_at"))


def _maintained(t: B.Tables) -> list[DataFrame]:
    """The registry before and after a toggle, an update and a deletion."""
    kept = ["id", "user_id", "name", "similarity_threshold", "is_active", "updated_at", "seq"]
    rows = materialise(t.strategies().drop("query_vector"), "strategies")
    toggled = tables.toggle_strategies(rows, rows.where("seq % 7 = 0").select("id", "user_id"), B.now())
    asked = toggled.where("seq % 4 = 0").withColumns({
        "name": F.concat(F.lit("renamed "), "seq"), "similarity_threshold": F.lit(0.75), "version": F.lit(1),
        "user_id": F.when(F.col("seq") % 3 == 0, "stranger").otherwise(F.col("user_id"))})
    updated = tables.update_strategies(toggled, asked, B.now(), "version")
    steps = [rows, toggled, updated, tables.delete_strategies(updated, updated.where("seq % 9 = 0"))]
    return [materialise(step.select(*kept), "step") for step in steps]


def _feed(steps: list[DataFrame]) -> DataFrame:
    return feeds.fan_in(*[changes.changes(a, b, "id", n + 1) for n, (a, b) in enumerate(zip(steps, steps[1:]))])


@query
def strategy_change_feed(t):
    touched = changes.fields_changed(_feed(_maintained(t)).where(F.col("kind") != changes.DELETE))
    gone = _feed(_maintained(t)).where(F.col("kind") == changes.DELETE).select("key", "version", "kind", F.lit("*").alias("field"))
    return touched.unionByName(gone)


@query
def strategies_replayed(t):
    """The change feed, part of it seen twice, replayed onto the old registry; and undone again."""
    steps = _maintained(t)
    feed = materialise(_feed(steps), "changes")
    new = changes.replay(steps[0], feed.unionByName(feed.where("version > 1")), "id")
    old = changes.undo(new, feed, "id")
    view = ["id", "user_id", "name", "similarity_threshold", "is_active", time("updated_at")]
    return new.select(F.lit("new").alias("state"), *view).unionByName(old.select(F.lit("old").alias("state"), *view))


@query
def stream_counters_replayed(t):
    """The six counters of a stream over outcomes and alerts, of which one batch runs twice."""
    spark = t.spark
    outcomes = t.outcomes().select(F.lit("event").alias("kind"), "outcome", F.col("failed_calls").cast("long").alias("failed_calls"), "seq")
    alerts = ranking.match_at_arrival(t.arrivals(), t.interests()).select(
        F.lit("alert").alias("kind"), F.lit(None).cast("string").alias("outcome"), F.lit(0).cast("long").alias("failed_calls"), F.col("event_id").cast("long").alias("seq"))
    rows = materialise(outcomes.unionByName(alerts), "handled")
    path, progress = scratch_path(spark, "handled"), scratch_path(spark, "progress")
    store = stored.CounterStore(spark, scratch_path(spark, "counters"))
    listener = stored.StoredCounters(store)
    event = F.col("kind") == "event"
    of_events = {name: F.count_if(event & condition) for name, condition in (
        ("events_ingested", F.lit(True)), ("events_processed", F.col("outcome") != enrichment.ERROR),
        ("events_enriched", F.col("outcome") == enrichment.ENRICHED), ("errors_total", F.col("outcome") == enrichment.ERROR))}

    def run(step: int, batches: int) -> None:
        rows.where(F.col("seq") % 3 == step).write.mode("append").parquet(path)
        arriving = stored.observed(spark.readStream.schema(rows.schema).parquet(path), **of_events,
                                   retry_attempts=F.sum("failed_calls"), alerts_triggered=F.count_if(~event))
        arriving.writeStream.format("noop").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        waited = 0.0
        while sum(listener.seen.values()) < batches and waited < 60:  # progress arrives after the batch
            clock.sleep(0.2)
            waited += 0.2

    spark.streams.addListener(listener)
    try:
        run(0, 1)
        run(1, 2)
        commit = spark._jvm.org.apache.hadoop.fs.Path(f"{progress}/commits/1")  # as if killed before the commit
        commit.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commit, False)
        run(2, 4)
    finally:
        spark.streams.removeListener(listener)
    return store.totals()
