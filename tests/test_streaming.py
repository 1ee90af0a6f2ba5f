"""Streams give what the batch operators give, and replays change nothing."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import corpus, enrichment, ranking, sinks
from tidewatch.schemas import ALERT, EVENT
from tidewatch.session import materialise, read_parts, scratch_scope
from tidewatch.sources import feeds
from tidewatch.streaming import ingest, matcher
from tidewatch.streaming.job import FAILURE, EventJob

T0 = dt.datetime(2024, 1, 1)
DIM = 4


def vector(rng):
    return [rng.uniform(-1, 1) for _ in range(DIM)]


def make(n, seed=2):
    rng = random.Random(seed)
    events, vectors = [], []
    for i in range(n):
        t = T0 + dt.timedelta(seconds=i)
        events.append((f"e{i}", rng.choice("xy"), rng.sample(["A", "B"], rng.randint(0, 2)), f"title {i}",
                       f"u{i}", "text " * 20, t, t))
        vectors.append((f"e{i}", vector(rng)))
    return events, vectors


def registry(seed=2, n=6):
    rng = random.Random(seed)
    return [(f"s{i}", f"user{i % 2}", f"watch {i}", [["x"], []][i % 2], [["A"], [], []][i % 3], 0.1 * (i % 2),
             "o@x", vector(rng)) for i in range(n)]


REGISTRY = ("id string, user_id string, description string, source array<string>, tickers array<string>, "
            "similarity_threshold double, owner_email string, query_vector array<float>")


def batch_alerts(spark, events, vectors, strategies):
    from tidewatch.operators import matching
    e = spark.createDataFrame(events, EVENT).join(spark.createDataFrame(vectors, "id string, vector array<float>"), "id")
    s = matching.interests(spark.createDataFrame(strategies, REGISTRY), "query_vector")
    found = ranking.match_at_arrival(matching.arrivals(e, "ingested_at", "vector"), s)
    return {(r.strategy_id, r.event_id, r.score) for r in found.collect()}


def run_job(spark, root, events, vectors, registries, broken=frozenset(), replay=False, cuts=None, **options):
    """Feed the events in as many batches as there are registries."""
    vec = spark.createDataFrame(vectors, "id string, vector array<float>").cache()
    state = {"registry": registries[0], "broken": set()}

    def enrich(frame):
        bad = F.col("id").isin(*state["broken"]) if state["broken"] else F.lit(False)
        joined = frame.join(vec, "id", "left").withColumn("vector", F.when(~bad, F.col("vector")))
        return joined.withColumn("outcome", enrichment.outcome(F.lit(True), "raw_text", "vector"))

    job = EventJob(spark, root, lambda: spark.createDataFrame(state["registry"], REGISTRY), enrich,
                   [sinks.table_sink(f"{root}/alerts", F.col("ingested_at"))], **options)
    cuts = cuts or [len(events) * i // len(registries) for i in range(len(registries) + 1)]
    for number, strategies in enumerate(registries):
        state["registry"] = strategies
        state["broken"] = set(broken) if number == 0 else set()
        part = spark.createDataFrame(events[cuts[number]:cuts[number + 1]], EVENT)
        for _ in range(2 if replay else 1):
            job.process(part, number)
    return job


def job_alerts(spark, root):
    rows = read_parts(spark, f"{root}/alerts", ALERT).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {(r.strategy_id, r.event_id, r.similarity_score) for r in rows}


def one_interest(*axis):
    return [("s", "user", "watch", [], [], 0.0, "o@x", list(axis))]


def test_an_event_delivered_again_replaces_its_point(spark, tmp_path):
    """k = 2: e1 twice is one point, so e2 ranks second; a lowered score lets an older point back in."""
    def event(i, seconds):
        t = T0 + dt.timedelta(seconds=seconds)
        return (f"e{i}", "x", [], f"t{i}", "u", "text " * 20, t, t)

    state = {}
    job = EventJob(spark, str(tmp_path), lambda: spark.createDataFrame(one_interest(1.0, 0.0), REGISTRY),
                   lambda f: f.join(spark.createDataFrame(state["v"], "id string, vector array<float>"), "id").withColumn(
                       "outcome", F.lit("enriched")), [sinks.table_sink(f"{tmp_path}/alerts", F.col("ingested_at"))], k=2)
    steps = [[("e1", [1.0, 0.0])], [("e1", [1.0, 1.0])], [("e2", [1.0, 2.0])],   # e2: 0.447, rank 2
             [("e3", [1.0, 0.5])],                                               # e3: 0.894, now e3, e1
             [("e3", [1.0, 9.0])],                                               # lowered: e1 and e2 are best again
             [("e4", [1.0, 3.0])]]                                               # 0.316: outranked by both
    ranks = {}
    for number, vectors in enumerate(steps):
        state["v"] = vectors
        job.process(spark.createDataFrame([event(int(vectors[0][0][1]), number)], EVENT), number)
        ranks[number] = spark.read.parquet(f"{tmp_path}/alerts/batch={number}").count()
    assert ranks == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    alerts = sinks.read_alerts(spark, f"{tmp_path}/alerts").collect()
    assert sorted(r.event_id for r in alerts) == ["e1", "e2", "e3"]
    assert {r.event_id: r.similarity_score for r in alerts}["e1"] == 0.707107


def test_empty_batches_keep_what_waits_and_lost_parts_are_errors(spark, tmp_path):
    events, vectors = make(20)
    root = str(tmp_path)
    job = run_job(spark, root, events, vectors, [registry()], broken={"e3", "e4"})
    nothing = spark.createDataFrame([], EVENT)
    job.process(nothing, 1)
    assert spark.read.schema(FAILURE).parquet(f"{root}/failures/batch=1").count() == 2
    job.clock = lambda: T0 + dt.timedelta(days=1)
    job.process(nothing, 2)  # the clock moves on without events: they are tried again, and fail again
    tried = spark.read.schema(FAILURE).parquet(f"{root}/failures/batch=2").collect()
    assert sorted((r.id, r.attempts) for r in tried) == [("e3", 2), ("e4", 2)]
    assert job.counters().first().retry_attempts == 4
    with pytest.raises(FileNotFoundError):
        job.process(nothing, 9)


def test_exhausted_failures_go_to_the_dead_part_once(spark, tmp_path):
    events, _ = make(2)
    root, clock = str(tmp_path), {"t": T0}
    job = EventJob(spark, root, lambda: spark.createDataFrame(registry(), REGISTRY),
                   lambda f: f.withColumn("vector", F.lit(None).cast("array<float>")).withColumn("outcome", F.lit("error")),
                   clock=lambda: clock["t"])
    job.process(spark.createDataFrame(events, EVENT), 0)
    for number in range(1, 6):
        clock["t"] += dt.timedelta(hours=1)
        job.process(spark.createDataFrame([], EVENT), number)
    dead = read_parts(spark, f"{root}/dead", FAILURE).collect()
    assert sorted(r.id for r in dead) == ["e0", "e1"] and {r.attempts for r in dead} == {4}
    assert spark.read.schema(FAILURE).parquet(f"{root}/failures/batch=5").count() == 0
    row = job.counters().first()
    assert (row.events_ingested, row.errors_total, row.retry_attempts) == (2, 8, 8)


def test_a_failing_sink_is_recorded_and_the_stream_goes_on(spark, tmp_path):
    events, vectors = make(30)
    root, calls = str(tmp_path), []
    vec = spark.createDataFrame(vectors, "id string, vector array<float>")

    def flaky(messages, batch_id):
        calls.append(batch_id)
        if batch_id == 0:
            raise OSError("mail is down")

    job = EventJob(spark, root, lambda: spark.createDataFrame(registry(), REGISTRY),
                   lambda f: f.join(vec, "id").withColumn("outcome", F.lit("enriched")),
                   [flaky, sinks.table_sink(f"{root}/alerts", F.col("ingested_at"))])
    for number in range(2):
        job.process(spark.createDataFrame(events[15 * number:15 * number + 15], EVENT), number)
    assert calls == [0, 1] and job_alerts(spark, root) == batch_alerts(spark, events, vectors, registry())
    counts = [spark.read.parquet(f"{root}/alerts/batch={n}").count() for n in (0, 1)]
    row = job.counters().first()
    assert (row.alerts_triggered, row.errors_total) == (counts[1], counts[0])
    job.raise_sink_errors = True
    with pytest.raises(OSError):
        job.process(spark.createDataFrame(events[:1], EVENT), 0)


@pytest.mark.parametrize("files", [1, 4])
def test_stateful_stream_equals_batch(spark, tmp_path, files):
    events, vectors = make(60)
    frame = spark.createDataFrame(events, EVENT).join(
        spark.createDataFrame(vectors, "id string, vector array<float>"), "id").select(
        F.col("id").alias("event_id"), "source", "tickers", "ingested_at", "vector").cache()
    landing = str(tmp_path / "in")
    for n in range(files):
        lo, hi = 60 * n // files, 60 * (n + 1) // files
        part = frame.where((F.unix_timestamp("ingested_at") - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()))
                           .between(lo, hi - 1))
        part.coalesce(1).write.mode("append").parquet(landing)
    from tidewatch.operators import matching
    interests = matching.interests(spark.createDataFrame(registry(), REGISTRY), "query_vector")
    found = matcher.stream_matches(ingest.read_events(spark, landing, frame.schema, files_per_trigger=1), interests)
    run = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.strategy_id, r.event_id, r.score) for r in rows}
    assert got == batch_alerts(spark, events, vectors, registry()) and len(got) == len(rows) > 60


def test_a_registry_of_several_blocks_is_the_state_of_shards(spark, tmp_path):
    events, vectors = make(60)
    frame = spark.createDataFrame(events, EVENT).join(
        spark.createDataFrame(vectors, "id string, vector array<float>"), "id").select(
        F.col("id").alias("event_id"), "source", "tickers", "ingested_at", "vector")
    frame = materialise(frame, "arrivals")
    landing = str(tmp_path / "in")
    for half in (F.col("event_id").substr(2, 9).cast("int") < 30, F.col("event_id").substr(2, 9).cast("int") >= 30):
        frame.where(half).coalesce(1).write.mode("append").parquet(landing)
    from tidewatch.operators import matching
    interests = matching.interests(spark.createDataFrame([*registry(), registry()[1]], REGISTRY), "query_vector")
    found = matcher.stream_matches(ingest.read_events(spark, landing, frame.schema, files_per_trigger=1), interests, max_block_bytes=1, shards=2)
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.strategy_id, r.event_id, r.score) for r in rows}
    twice = sum(name == "s1" for name, _, _ in got)
    assert got == batch_alerts(spark, events, vectors, registry()) and len(got) + twice == len(rows) and twice > 5


@pytest.mark.parametrize("batches, replay", [(1, False), (3, True)])
def test_job_equals_batch_and_replays_are_idempotent(spark, tmp_path, batches, replay):
    events, vectors = make(60)
    job = run_job(spark, str(tmp_path), events, vectors, [registry()] * batches, replay=replay)
    assert job_alerts(spark, str(tmp_path)) == batch_alerts(spark, events, vectors, registry())
    row = job.counters().first()
    assert (row.events_ingested, row.events_processed, row.events_enriched, row.errors_total) == (60, 60, 60, 0)
    assert row.alerts_triggered == len(job_alerts(spark, str(tmp_path)))


def test_the_job_folds_its_points_and_finds_the_same(spark, tmp_path):
    """Every batch is replayed, parts are folded as soon as there are two finished ones, and a strategy
    edited for the last batch is searched in what was folded."""
    events, vectors = make(60)
    plan = [registry(), registry(), registry(), registry(seed=5)]
    folded = run_job(spark, str(tmp_path / "a"), events, vectors, plan, replay=True, max_parts=1)
    plain = run_job(spark, str(tmp_path / "b"), events, vectors, plan)
    assert job_alerts(spark, str(tmp_path / "a")) == job_alerts(spark, str(tmp_path / "b"))
    parts = [corpus.point_log(spark, job.path("points")).parts() for job in (folded, plain)]
    assert len(parts[0]) == 2 and len(parts[1]) == 4
    logs = [corpus.newest_points(corpus.point_log(spark, job.path("points")).read()).count() for job in (folded, plain)]
    assert logs == [60, 60]


def test_the_job_sorts_out_the_best_before_it_names_points(spark, tmp_path, monkeypatch):
    asked, real = [], ranking.best_scores
    monkeypatch.setattr(ranking, "best_scores", lambda scored, k, *keys: asked.append(keys) or real(scored, k, *keys))
    events, vectors = make(60)
    run_job(spark, str(tmp_path), events, vectors, [registry()] * 2)
    assert asked == [("strategy_id",), ("strategy_id", "definition")] * 2
    assert job_alerts(spark, str(tmp_path)) == batch_alerts(spark, events, vectors, registry())


def test_registry_changes_take_effect_on_the_next_batch(spark, tmp_path):
    """New, edited and re-activated strategies rank against the whole corpus so far."""
    events, vectors = make(60)
    full = registry()
    fewer = full[:-2]                                         # s4, s5 paused in the second batch
    edited = [(*full[0][:7], vector(random.Random(99))), *full[1:]]  # s0 rewritten for the third
    run_job(spark, str(tmp_path), events, vectors, [full, fewer, edited])
    got = job_alerts(spark, str(tmp_path))
    whole, new = batch_alerts(spark, events, vectors, full), batch_alerts(spark, events, vectors, edited)
    index = lambda e: int(e[1:])
    expected = {a for a in whole if a[0] in ("s1", "s2", "s3")}
    expected |= {a for a in whole if a[0] in ("s4", "s5") and not 20 <= index(a[1]) < 40}
    expected |= {a for a in whole if a[0] == "s0" and index(a[1]) < 40}
    expected |= {a for a in new if a[0] == "s0" and index(a[1]) >= 40}
    assert got == expected


def test_vectors_of_another_length_stay_out(spark, tmp_path):
    events, vectors = make(10)
    vectors[3] = ("e3", [1.0] * (DIM + 1))
    root = str(tmp_path)
    vec = spark.createDataFrame(vectors, "id string, vector array<float>")
    job = EventJob(spark, root, lambda: spark.createDataFrame(registry(), REGISTRY),
                   lambda f: f.join(vec, "id").withColumn("outcome", F.lit("enriched")), dim=DIM)
    job.process(spark.createDataFrame(events, EVENT), 0)
    assert corpus.read_points(spark, f"{root}/points").count() == 9
    assert job.counters().first().errors_total == 1


def test_intermediates_are_removed_with_their_batch(spark, tmp_path):
    with scratch_scope(spark) as folder:
        frame = materialise(spark.range(3), "x")
        assert frame.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))


def test_failed_embeddings_wait_and_come_back(spark, tmp_path):
    events, vectors = make(40)
    root = str(tmp_path)
    job = run_job(spark, root, events, vectors, [registry()] * 2, broken={"e3", "e4"})
    failures = read_parts(spark, f"{root}/failures", FAILURE)
    first = failures.where("batch = 0").collect()
    assert {(r.id, r.attempts, r.exhausted) for r in first} == {("e3", 1, False), ("e4", 1, False)}
    assert all(r.next_attempt_at - r.failed_at == dt.timedelta(milliseconds=500) for r in first)
    assert failures.where("batch = 1").count() == 0
    row = job.counters().first()
    assert (row.events_ingested, row.events_processed, row.errors_total, row.retry_attempts) == (40, 40, 2, 2)


def test_dedupe_and_counters(spark, tmp_path):
    events, _ = make(30)
    landing = str(tmp_path / "in")
    for rows in (events[:20], events[10:], events[:5]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(landing)
    listener = ingest.CounterListener()
    spark.streams.addListener(listener)
    stream = ingest.dedupe_stream(ingest.counted(ingest.read_events(spark, landing, EVENT, files_per_trigger=1)))
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(e[0] for e in events)
    import time
    for _ in range(50):
        if listener.totals.get("events_ingested") == 45:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.totals == {"events_ingested": 45, "events_undated": 0}


def test_both_producers_as_one_stream(spark, tmp_path):
    """JSON news and XML filings, fanned in, de-duplicated and re-delivered."""
    news, filings = tmp_path / "news", tmp_path / "filings"
    news.mkdir(), filings.mkdir()
    item = '{"id":"n%d","tickers":["A"],"title":"t","article_url":"u","published_utc":"2024-01-01T00:00:00Z"}\n'
    (news / "1.json").write_text(item % 1 + item % 2)
    (news / "2.json").write_text(item % 2 + item % 3)
    entry = ('<entry><title>8-K - X (%d) (Filer)</title><link href="https://f.example"/>'
             '<updated>2024-01-01T10:00:00Z</updated><id>urn:%d</id></entry>')
    for n in (1, 2):
        body = entry % (7, 1) + entry % (8, n)
        (filings / f"{n}.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')
    known = spark.createDataFrame([("7", "SEVEN")], "cik string, ticker string")
    stamp = F.col("published_utc")
    stream = feeds.fan_in(
        feeds.normalise_news(feeds.read_news(spark, str(news), True, 1), stamp),
        feeds.normalise_filings(feeds.read_filings(spark, str(filings), True, 1), known, F.col("published")))
    run = ingest.dedupe_stream(stream).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 5
    assert {r.id: (r.source, r.tickers) for r in rows} == {
        "n1": ("Polygon.io", ["A"]), "n2": ("Polygon.io", ["A"]), "n3": ("Polygon.io", ["A"]),
        "urn:1": ("SEC EDGAR", ["SEVEN"]), "urn:2": ("SEC EDGAR", [])}


def test_bounded_dedupe(spark, tmp_path):
    events, _ = make(10)
    landing = str(tmp_path / "in")
    spark.createDataFrame(events + events[:3], EVENT).coalesce(1).write.parquet(landing)
    stream = ingest.dedupe_stream(ingest.read_events(spark, landing, EVENT), within="1 hour")
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
