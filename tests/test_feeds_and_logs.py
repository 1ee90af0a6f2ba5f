"""Polls, timers, live feeds, logs of parts, change feeds, classes and cells on small inputs."""

import json
import os
import random
import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import cells, changes, embedding, matching, partlog, predicate_index, ranking
from tidewatch.sources import feeds as producers
from tidewatch.sources import polls
from tidewatch.streaming import counters, ingest, ordered, retry
from tidewatch.streaming import feeds as live


def land(root, source, poll, items, files=2, complete=True):
    """Newest first, over several files."""
    folder = f"{root}/{source}/{poll}"
    os.makedirs(folder)
    cut = -(-len(items) // files)
    for number in range(files):
        lines = [i if isinstance(i, str) and i.startswith("{") else json.dumps({"id": i, "title": f"t{i}"}) for i in items[number * cut:(number + 1) * cut]]
        with open(f"{folder}/part-{number}.txt", "w") as out:
            out.write("".join(line + "\n" for line in lines))
    if complete:
        open(f"{folder}/_SUCCESS", "w").close()


def drain(spark, root, out, progress, **options):
    polled = polls.poll_stream(spark, root, **options)
    polled.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    return sorted(((r.source, r.poll, r.pos, r.id, r.error is not None) for r in spark.read.schema(polls.SCHEMA).parquet(out).collect()), key=repr)


def test_polls_follow_the_last_seen_id(spark, tmp_path):
    root, out, progress = (str(tmp_path / name) for name in ("polls", "out", "progress"))
    land(root, "news", 0, ["3", "2", "1"])
    land(root, "news", 1, ["5", "{broken", "4", "3"])     # discarded: the bad item is above the marker
    land(root, "news", 2, ["6", "5", "4", "3", "{bad"])   # what lies below the marker is not read
    land(root, "news", 3, ["6", "5"])                      # nothing new
    land(root, "news", 4, [])
    land(root, "filings", 0, ["b", "a"], files=1)
    land(root, "filings", 1, ["z", "y"])                   # the marker is gone: all of it
    land(root, "news", 5, ["8"], complete=False)
    first = [("filings", 0, 0, "b", False), ("filings", 0, 1, "a", False), ("filings", 1, 0, "z", False), ("filings", 1, 1, "y", False),
             ("news", 0, 0, "3", False), ("news", 0, 1, "2", False), ("news", 0, 2, "1", False), ("news", 1, None, None, True),
             ("news", 2, 0, "6", False), ("news", 2, 1, "5", False), ("news", 2, 2, "4", False)]
    assert drain(spark, root, out, progress, cursor=f"{progress}/cursor.json") == sorted(first, key=repr)
    land(root, "news", 6, ["9", "8", "6"])
    open(f"{root}/news/5/_SUCCESS", "w").close()
    more = [("news", 5, 0, "8", False), ("news", 6, 0, "9", False)]
    assert drain(spark, root, out, progress, cursor=f"{progress}/cursor.json") == sorted(first + more, key=repr)
    other = str(tmp_path / "again")  # without the remembered cursor the walk gives the same offsets
    assert drain(spark, root, other, str(tmp_path / "p2"), source="news") == sorted([r for r in first + more if r[0] == "news"], key=repr)


def test_a_poll_is_walked_over_once_per_offset(tmp_path, monkeypatch):
    """By a restarted reader too; walks are forgotten when their offset is committed."""
    root = str(tmp_path / "polls")
    land(root, "news", 0, ["3", "2", "1"])
    land(root, "news", 1, ["5", "4", "3"])
    opened, lines = [], polls._lines
    monkeypatch.setattr(polls, "_lines", lambda system, path: opened.append(path) or lines(system, path))
    reader = polls._PollReader({"path": root})
    start, end = reader.initialOffset(), reader.latestOffset()
    once = reader.partitions(start, end)
    assert len(opened) == 4 and [s.rows for s in once] == [2, 1, 2]
    reader.commit(end)
    assert not reader.walked
    again = polls._PollReader({"path": root})
    assert again.partitions(start, end) == once and again.partitions(start, end) == once and len(opened) == 8


def test_pollers_hand_events_to_the_landing(spark, tmp_path):
    root, landing, progress = (str(tmp_path / name) for name in ("polls", "events", "progress"))
    item = {"id": "n1", "tickers": ["X"], "title": "T", "article_url": "http://a", "published_utc": "2024-01-02T03:04:05Z"}
    land(root, "news", 0, [json.dumps(item)], files=1)
    land(root, "filings", 0, ["{broken"], files=1)

    def news(items):
        parsed = producers.parse_news(items.select("body"), "body")
        return producers.normalise_news(parsed, F.lit("2024-01-02 04:00:00").cast("timestamp"))

    def filings(items):
        return news(items)

    running = ingest.start_pollers(spark, root, {"news": news, "filings": filings}, landing, progress, availableNow=True)
    for run in running.values():
        run.awaitTermination()
    events = spark.read.parquet(f"{landing}/[!_]*/*")
    assert [(r.id, r.source, r.tickers) for r in events.collect()] == [("n1", "Polygon.io", ["X"])]
    assert spark.read.parquet(f"{landing}/_discarded/filings/*").count() == 1
    assert ingest.PACE == {"news": "12 seconds", "filings": "90 seconds"}


def test_retries_come_due_without_further_events(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("ok", "0"), ("twice", "2"), ("never", "9"), ("null", None)]
    spark.createDataFrame(rows, "id string, body string").write.parquet(path)

    def attempt(key, body, tries):
        if tries < int(body):
            raise OSError("not yet")
        return f"{key} {tries}"

    quick = {"max_retries": 3, "base_ms": 200, "max_ms": 1_000, "multiplier": 2.0}
    arriving = ingest.read_events(spark, path, spark.read.parquet(path).schema)
    run = (retry.with_retries(arriving, attempt, quick).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "p"))
           .trigger(processingTime="200 milliseconds").start(out))
    deadline = time.time() + 90
    found = {}
    while time.time() < deadline and len(found) < 4:
        time.sleep(0.5)
        found = {r.id: r for r in spark.read.schema(retry.OUTCOME).parquet(out).collect()} if os.path.exists(out) else {}
    run.stop()
    assert {k: (r.outcome, r.tries, r.value) for k, r in found.items()} == {
        "ok": ("done", 1, "ok 0"), "twice": ("done", 3, "twice 2"), "never": ("exhausted", 4, None), "null": ("exhausted", 4, None)}
    assert found["ok"].waited_ms == 0 and found["twice"].waited_ms >= 300 and found["never"].waited_ms >= 600


def test_waiting_events_of_a_shard_are_one_state(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"e{n}", str(n % 5)) for n in range(200)]
    spark.createDataFrame(rows + rows[:50], "id string, body string").write.parquet(path)

    def attempt(key, body, tries):
        if tries < int(body):
            raise OSError("not yet")
        return f"{key} {tries}"

    quick = {"max_retries": 3, "base_ms": 200, "max_ms": 1_000, "multiplier": 2.0}
    arriving = ingest.read_events(spark, path, spark.read.parquet(path).schema)
    run = (retry.with_retries(arriving, attempt, quick, shards=4).writeStream.format("parquet")
           .option("checkpointLocation", str(tmp_path / "p")).trigger(processingTime="200 milliseconds").start(out))
    deadline, found = time.time() + 90, []
    while time.time() < deadline and len(found) < 200:
        time.sleep(0.5)
        found = spark.read.schema(retry.OUTCOME).parquet(out).collect() if os.path.exists(out) else []
    states = [state["numRowsTotal"] for progress in run.recentProgress for state in progress["stateOperators"]]
    run.stop()
    assert sorted((r.id, r.outcome, r.tries, r.value) for r in found) == sorted(
        (name, "exhausted", 4, None) if body == "4" else (name, "done", int(body) + 1, f"{name} {body}") for name, body in rows)
    assert 0 < max(states) <= 40  # 4 shards with their timers, not 160 events


def test_delays_grow_to_a_limit():
    config = {"max_retries": 3, "base_ms": 100, "max_ms": 150, "multiplier": 10.0}
    assert [retry.delay_ms(n, config, 1.0) for n in (1, 2, 3)] == [100, 150, 150]
    assert [retry.delay_ms(n, config, 0.0) for n in (1, 2)] == [50, 75]


def test_live_feed_keeps_a_bounded_buffer_between_batches(spark, tmp_path):
    path, out, progress = (str(tmp_path / name) for name in ("in", "out", "p"))
    schema = "user_id string, at timestamp, kind string, id string, payload string, n int"
    at = [datetime(2024, 1, 1, 0, n) for n in range(10)]

    def alerts(user, ids, minute):
        return [(user, at[minute], "alert", i, f"p{i}", None) for i in ids]

    steps = [alerts("u", "abcde", 1) + alerts("v", "x", 1), [("u", at[2], "take", None, None, 2), ("w", at[2], "take", None, None, 9)],
             alerts("u", "fgh", 3) + [("u", at[4], "take", None, None, 9)], [("v", at[5], "leave", None, None, None), ("v", at[6], "take", None, None, 5)]]
    for rows in steps:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
        arriving = spark.readStream.schema(schema).parquet(path)
        live.live_feed(arriving, size=3).writeStream.format("parquet").option("checkpointLocation", progress).trigger(
            availableNow=True).start(out).awaitTermination()
    got = sorted((r.user_id, r.status, r.seq, r.id) for r in spark.read.schema(live.FEED).parquet(out).collect())
    assert got == [("u", "delivered", 1, "a"), ("u", "delivered", 2, "b"), ("u", "delivered", 3, "c"), ("u", "delivered", 4, "f"), ("u", "delivered", 5, "g"),
                   ("u", "dropped", 1, "d"), ("u", "dropped", 2, "e"), ("u", "dropped", 3, "h")]


class Held:
    """A state variable outside of Spark."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None


def test_a_users_rows_are_sorted_and_handed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(live, "HELD_BYTES", 20_000)
    monkeypatch.setattr(live, "_FRAME_BYTES", 30_000)
    rng = random.Random(4)
    rows = [(rng.randrange(50), "alert", f"a{i}", f"p{i}" * 10, 0) for i in range(3000)] + [(60, "take", None, None, 2), (70, "alert", "last", None, 0)]
    rng.shuffle(rows)
    buffer = live._Buffer(3)
    buffer.pending, buffer.counts = Held(), Held()
    frames = (pd.DataFrame(rows[i:i + 500], columns=["at", "kind", "id", "payload", "n"]) for i in range(0, len(rows), 500))
    found = buffer.handleInputRows(("u",), frames, None)
    pieces = [len(frame) for frame in found]
    assert sum(pieces) == 2999 and max(pieces) < 100
    order = [r[2:4] for r in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")) if r[1] == "alert"]
    assert buffer.pending.value == [order[2], order[-1]] and buffer.counts.value == (2, 2997)


@pytest.mark.parametrize("held_bytes", [1, 40, 10 ** 6])
def test_rows_are_merged_from_sorted_runs(held_bytes, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE_BYTES", 15)
    rng = random.Random(held_bytes)
    rows = [(rng.randrange(6), i) for i in range(200)]
    assert list(ordered.in_order(iter(rows), lambda r: r[0], lambda r: 4, held_bytes)) == sorted(rows)


# -- logs of parts ----------------------------------------------------------------------

ROW = T.StructType([T.StructField("owner", T.StringType()), T.StructField("value", T.LongType())])


def rows_of(frame):
    return sorted((r.owner, r.value) for r in frame.collect())


def test_part_log_versions_replays_and_compaction(spark, tmp_path):
    log = partlog.PartLog(spark, str(tmp_path / "log"), ROW, ("owner",), max_parts=2)

    def frame(*rows):
        return spark.createDataFrame(list(rows), ROW)

    assert log.versions() == [] and log.read().count() == 0
    log.commit(frame(("a", 1), ("b", 2)), 0)
    log.commit(frame(("a", 3)), 1)
    log.commit(frame(("a", 4)), 1)  # the batch again: it replaces itself
    assert rows_of(log.read()) == [("a", 1), ("a", 4), ("b", 2)] and rows_of(log.read(2)) == [("a", 1), ("a", 3), ("b", 2)]
    assert rows_of(log.read(before=1)) == [("a", 1), ("b", 2)]
    log.commit(frame(("c", 5), (None, 6)), 2)
    assert log.compact(lambda parts: parts.where("value <> 1"), before=2) is None  # not too many finished ones yet
    log.commit(frame(("d", 7)), 3)
    assert log.compact(lambda parts: parts.where("value <> 1"), before=3, files=4) == 6
    assert len(log.parts()) == 2 and len(log.parts(5)) == 4
    assert sorted(log.read().select("value").toPandas()["value"]) == [2, 4, 5, 6, 7]
    assert sorted(log.read(5).select("value").toPandas()["value"]) == [1, 2, 4, 5, 6, 7]
    assert len(log.vacuum(keep=1)) == 4 and log.versions() == [6]
    assert sorted(log.read().select("value").toPandas()["value"]) == [2, 4, 5, 6, 7]


def test_two_writers_of_one_version(spark, tmp_path):
    log = partlog.PartLog(spark, str(tmp_path / "log"), ROW)
    assert log._publish(1, []) and not log._publish(1, [{"part": "lost"}])
    assert log.parts(1) == []
    assert log.commit(spark.createDataFrame([("a", 1)], ROW), 0) == 2


def test_reads_of_one_owner_open_few_files(spark, tmp_path):
    log = partlog.PartLog(spark, str(tmp_path / "log"), ROW, ("owner",))
    rows = [(f"owner {n % 40:02}", n) for n in range(4_000)]
    for batch in range(3):
        log.commit(spark.createDataFrame([r for r in rows if r[1] % 3 == batch], ROW).repartition(4), batch)
    log.compact(lambda parts: parts, before=3, files=8, force=True)
    every = sum(len(p["files"]) for p in log.parts())
    for owner in ("owner 07", "owner 39", "nobody", "owner 07x"):
        assert rows_of(log.read(where={"owner": owner})) == sorted(r for r in rows if r[0] == owner)
        assert len(log.opened) <= (2 if owner in {r[0] for r in rows} else 0) < every


# -- change feeds, classes, cells, counters -----------------------------------------------


def test_changes_replayed_give_the_new_table(spark):
    schema = "id string, name string, tags array<string>"
    old = spark.createDataFrame([("a", "x", ["1"]), ("b", None, None), ("c", "z", []), ("d", "same", None)], schema)
    new = spark.createDataFrame([("a", "y", ["1"]), ("b", None, []), ("d", "same", None), ("e", "new", None)], schema)
    feed = changes.changes(old, new, "id", 1).cache()
    assert sorted((r.key, r.kind) for r in feed.collect()) == [("a", "update"), ("b", "update"), ("c", "delete"), ("e", "insert")]
    assert sorted((r.key, r.field) for r in changes.fields_changed(feed).where("kind = 'update'").collect()) == [("a", "name"), ("b", "tags")]
    same = lambda frame: sorted(map(repr, frame.select("id", "name", "tags").collect()))
    assert same(changes.replay(old, feed.union(feed), "id")) == same(new)
    assert same(changes.undo(new, feed, "id")) == same(old)


def test_classes_give_the_same_pairs_from_fewer_tests(spark):
    generator = np.random.default_rng(2)
    lists = [None, [], ["A"], ["B", "A"], ["A", "B", "A"], ["C", None]]
    events = [(str(n), [None, "s", "r"][generator.integers(3)], lists[generator.integers(6)]) for n in range(300)]
    wanted = [(str(n), [None, [], ["s"], ["r", "s"]][generator.integers(4)], lists[generator.integers(6)], 0.0) for n in range(80)]
    e = spark.createDataFrame(events, "event_id string, source string, tickers array<string>")
    w = spark.createDataFrame(wanted, "strategy_id string, wanted_sources array<string>, wanted_tickers array<string>, threshold double")
    pairs = lambda f: sorted((r.event_id, r.strategy_id) for r in f.collect())
    assert pairs(predicate_index.prefilter_pairs(e, w)) == pairs(matching.prefilter_join(e, w))
    found = predicate_index.class_pairs(predicate_index.event_members(e), predicate_index.strategy_members(w)).collect()
    assert len(found) < 300 and sum(r.events * r.strategies for r in found) == matching.prefilter_join(e, w).count()
    plain = matching.strategies_passed(matching.prefilter_join(e, w))
    assert sorted(map(tuple, predicate_index.strategies_passed(e, w).collect())) == sorted(map(tuple, plain.select("event_id", "strategies").collect()))


POINTS = "point_id string, source string, tickers array<string>, vector array<float>"
WANTED = "strategy_id string, wanted_sources array<string>, wanted_tickers array<string>, threshold double, query_vector array<float>"


def test_cells_are_skipped_only_when_a_bound_proves_it(spark):
    generator = np.random.default_rng(5)
    middles = generator.normal(size=(12, 16))
    vectors = middles[generator.integers(0, 12, 900)] + generator.normal(size=(900, 16)) * 0.1
    vectors[:5] = 0
    points = [(f"p{n:03}", ["s", "r"][n % 2], [["A"], [], ["B"]][n % 3], v.tolist()) for n, v in enumerate(vectors)]
    points += [("odd", "s", [], [1.0]), ("none", "s", [], None)]
    queries = list(middles) + [np.zeros(16), generator.normal(size=16)]
    wanted = [(f"q{n:02}", [None, ["s"]][n % 2], [None, ["A"], ["Z"]][n % 3], 0.0, q.tolist()) for n, q in enumerate(queries)]
    p, w = spark.createDataFrame(points, POINTS), spark.createDataFrame(wanted, WANTED)
    found = cells.search_cells(cells.build_cells(p, cells=12), w, k=10)
    key = lambda f: sorted((r.strategy_id, r.rank, r.point_id, r.score) for r in f.collect())
    assert key(found.hits) == key(ranking.vector_search(p, w, 10))
    assert 0 < found.read < found.pairs / 2
    assert cells.search_cells(cells.build_cells(p.limit(0)), w).hits.count() == 0


def test_cells_are_scored_once_and_hand_on_what_reaches_the_known_scores(spark, monkeypatch):
    generator = np.random.default_rng(6)
    points = [(f"p{n:03}", "s", [], v.tolist()) for n, v in enumerate(generator.normal(size=(600, 8)))]
    wanted = [(f"q{n:02}", None, None, 0.0, v.tolist()) for n, v in enumerate(generator.normal(size=(20, 8)))]
    p, w = spark.createDataFrame(points, POINTS), spark.createDataFrame(wanted, WANTED)
    passes, real = [], cells._scored
    monkeypatch.setattr(cells, "_scored", lambda c, block, asked, *rest: passes.append((asked, real(c, block, asked, *rest))) or passes[-1][1])
    hits = cells.search_cells(cells.build_cells(p, cells=12), w, k=5).hits
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, ranking.vector_search(p, w, 5).select(*hits.columns).collect()))
    (near, first), (rest, second) = passes
    assert rest.any() and not (near & rest).any()
    least = {r.strategy_id: r.score for r in ranking.top_points(first, 5).where("rank = 5").collect()}
    found = second.collect()
    assert found and all(r.score >= least[r.strategy_id] for r in found) and len(found) < 20 * 5 * 11


def test_the_vectors_of_a_corpus_are_computed_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"p{n:02}", "s", [], [1.0, float(n)]) for n in range(40)], POINTS)
    cells.build_cells(rows.mapInArrow(count, POINTS), cells=2)
    assert computed.value == 40


def test_counters_overwrite_what_ran_before(spark, tmp_path):
    store = counters.CounterStore(spark, str(tmp_path / "c"))
    store.put("q", 0, {"events_ingested": 5})
    store.put("q", 1, {"events_ingested": 7, "errors_total": 1})
    store.put("q", 1, {"events_ingested": 2, "errors_total": 3})
    store.put("r", 1, {"alerts_triggered": 4})
    total = store.totals().first()
    assert (total.events_ingested, total.errors_total, total.alerts_triggered, total.retry_attempts) == (7, 3, 4, 0)


def test_queries_are_embedded_once_and_nulls_apart(spark):
    rows = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None), ("d", "??")], "id string, query string")
    got = {r.id: r.query_vector for r in embedding.embed_queries(rows, embedding.hashing_embedder(8)).collect()}
    assert got["a"] == got["b"] and got["a"] is not None and got["c"] is None and got["d"] is None and len(got) == 4


def test_single_precision_thresholds_in_matching(spark):
    """A score of 0.7 is not 0.7 in single precision; 0.75 is 0.75."""
    at = "2024-01-01 00:00:00"
    events = spark.createDataFrame([("x", "s", [], at, [0.7, float(np.sqrt(1 - 0.49))]), ("y", "s", [], at, [0.75, float(np.sqrt(1 - 0.5625))])],
                                   "event_id string, source string, tickers array<string>, at string, vector array<double>").withColumn(
        "ingested_at", F.col("at").cast("timestamp"))
    wanted = spark.createDataFrame([("low", None, None, 0.7, [1.0, 0.0]), ("high", None, None, 0.75, [1.0, 0.0])], WANTED)
    key = lambda f: sorted((r.strategy_id, r.event_id) for r in f.collect())
    assert key(ranking.match_at_arrival(events, wanted)) == [("high", "y"), ("low", "x"), ("low", "y")]
    assert key(ranking.match_at_arrival(events, wanted, single_precision=True)) == [("high", "y"), ("low", "y")]
