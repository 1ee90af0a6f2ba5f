"""Sources, registry maintenance, alerts, corpus and sinks on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts, corpus, counters, embedding, enrichment, sinks, tables
from tidewatch.schemas import ALERT, API_KEY, REQUEST_DEFAULTS, STRATEGY, TABLE_DEFAULTS
from tidewatch.session import read_parts
from tidewatch.sources import companies, feeds, pages, registry

T0 = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 2, 1)


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- sources


def test_news_from_json_lines(spark, tmp_path):
    items = [
        {"id": "n1", "tickers": ["AAPL"], "title": "a", "article_url": "u1", "published_utc": "2024-01-01T00:00:00Z"},
        {"id": "n2", "title": "b", "article_url": "u2", "published_utc": "2024-01-02T03:04:05Z", "extra": 1},
        {"id": "n3", "tickers": [], "title": "c", "article_url": "u3"},
    ]
    (tmp_path / "news.json").write_text("\n".join(map(json.dumps, items)))
    events = feeds.normalise_news(feeds.read_news(spark, str(tmp_path)), F.lit(NOW))
    dated, undated = feeds.split_undated(events)
    assert values(dated, "id", "source", "tickers", "content_url") == [
        ("n1", "Polygon.io", ["AAPL"], "u1"), ("n2", "Polygon.io", [], "u2")]
    assert values(undated, "id") == [("n3",)]


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Latest</title>
<entry><title>8-K - ACME &amp; CO (320193) (Filer)</title><link rel="alternate" type="text/html" href="https://f.example/1"/>
<updated>2024-01-01T10:00:00-05:00</updated><id>urn:1</id></entry>
<entry><title>8-K - PADDED (0000320193) (Filer)</title><link rel="alternate" href="https://f.example/2"/>
<updated>2024-01-01T11:00:00-05:00</updated><id>urn:2</id></entry>
<entry><title>8-K - SHADOWED (DE) (320193) (Filer)</title><link href="https://f.example/3"/><id>urn:3</id></entry>
</feed>"""


def test_filings_from_xml(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.xml").write_text(ATOM)
    (tmp_path / "companies.json").write_text(json.dumps({
        "0": {"cik_str": 320193, "ticker": "ACME", "title": "Acme"},
        "1": {"cik_str": 320193, "ticker": "ACMB", "title": "Acme"},
        "2": {"cik_str": 7, "ticker": "SEVEN", "title": "7"}}))
    known = companies.read_companies(spark, str(tmp_path / "companies.json"))
    assert values(known, "cik", "ticker") == [("320193", "ACMB"), ("7", "SEVEN")]
    entries = feeds.read_filings(spark, str(tmp_path / "feed"))
    strict = feeds.normalise_filings(entries, known, F.lit(NOW))
    assert values(strict, "id", "tickers", "content_url") == [
        ("urn:1", ["ACMB"], "https://f.example/1"), ("urn:2", [], "https://f.example/2"),
        ("urn:3", [], "https://f.example/3")]
    tolerant = feeds.normalise_filings(entries, known, F.lit(NOW), tolerant=True)
    assert values(tolerant, "id", "tickers") == [("urn:1", ["ACMB"]), ("urn:2", ["ACMB"]), ("urn:3", ["ACMB"])]
    dated, undated = feeds.split_undated(strict)
    assert values(undated, "id") == [("urn:3",)]
    assert values(dated, "id", "published_at")[0] == ("urn:1", dt.datetime(2024, 1, 1, 15))


def test_cursor(spark):
    feed = spark.createDataFrame(
        [("a", i, f"a{9 - i}") for i in range(5)] + [("b", i, f"b{i}") for i in range(3)] + [("c", 0, "c0")],
        "source string, pos int, id string")
    marks = spark.createDataFrame([("a", "a7"), ("b", "fell off"), ("c", "c0"), ("d", "d1")],
                                  "source string, last_id string")
    new = feeds.unseen(feed, marks).orderBy("source", "emit_order").collect()
    assert [r.id for r in new] == ["a8", "a9", "b2", "b1", "b0"]
    assert values(feeds.next_cursors(feed, marks), "source", "last_id") == [
        ("a", "a9"), ("b", "b0"), ("c", "c0"), ("d", "d1")]


def test_strategy_import(spark):
    bodies = {
        "good": '{"name":"n","query":"q","source":["x"],"similarity_threshold":0.4,"is_active":true}',
        "omitted": '{"name":"n","query":"q"}',
        "no name": '{"name":"","query":"q"}',
        "no query": '{"name":"n"}',
        "cut": '{"name":"n","query":"q","descr',
        "wrong type": '{"name":"n","query":"q","similarity_threshold":"high"}',
        "text": "hello", "null": None,
    }
    requests = spark.createDataFrame([(k, "u", v) for k, v in bodies.items()],
                                     "request_id string, user_id string, body string")
    accepted, rejected = registry.import_strategies(requests, F.lit(NOW))
    assert values(accepted, "request_id", "source", "similarity_threshold", "is_active") == [
        ("good", ["x"], 0.4, True), ("omitted", [], 0.0, False)]
    assert values(rejected, "request_id", "status") == [
        ("cut", "bad_json"), ("no name", "missing_field"), ("no query", "missing_field"), ("null", "bad_json"),
        ("text", "bad_json"), ("wrong type", "bad_json")]
    assert REQUEST_DEFAULTS["is_active"] is False
    again, _ = registry.import_strategies(requests, F.lit(NOW))
    assert values(again, "id") == values(accepted, "id")


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title></head><body><p>one</p><p>two &amp; three</p></body></html>", "one\ntwo & three"),
    ("<body><nav>menu</nav><article><h1>Head</h1><p>Body<br>line</p></article><footer>f</footer></body>",
     "Head\nBody\nline"),
    ("<body><script>var t='</p>';</script><style>p{}</style><!-- c --><div class='ad big'>buy<div>now</div></div>ok",
     "ok"),
    ("plain text", "plain text"), ("", ""), (None, None),
    ("<article><p>caf&eacute; &#8364;</p><script>x</script></article>tail", "café €"),
])
def test_readable_text(html, text):
    assert pages.readable_text(html) == text


def test_extract_text_keeps_whole_documents(spark):
    body = "word " * 50_000
    frame = spark.createDataFrame([("u", f"<article>{body}</article>")], "url string, html string")
    assert pages.extract_text(frame).first().text == body.strip()


# -- enrichment


def test_outcomes_and_embedding_of_linked_pages(spark):
    events = spark.createDataFrame(
        [("1", "u1"), ("2", "u1"), ("3", "u2"), ("4", "gone"), ("5", None), ("6", "u3")],
        "id string, content_url string").withColumn("raw_text", F.lit(None).cast("string"))
    texts = spark.createDataFrame(
        [("u1", "x" * 200), ("u2", "too short"), ("u3", "broken " * 20), ("unlinked", "y" * 200)],
        "url string, text string")
    asked = spark.sparkContext.accumulator(0)

    def model(batch):
        asked.add(len(batch))
        return [None if t.startswith("broken") else [1.0, float(len(t))] for t in batch]

    fetch = lambda urls: texts.join(urls, "url", "left_semi")
    got = enrichment.enrich(events, fetch, embedding.model_embedder(model))
    assert values(got, "id", "outcome") == [
        ("1", "enriched"), ("2", "enriched"), ("3", "skipped_short"), ("4", "skipped_fetch"),
        ("5", "skipped_fetch"), ("6", "error")]
    assert asked.value == 2, "each linked page long enough is embedded once"
    rows = counters.run_counters(got.withColumn("failed_calls", F.lit(1)), got.limit(3)).first()
    assert rows.asDict() == {"events_ingested": 6, "events_processed": 5, "events_enriched": 2,
                             "alerts_triggered": 3, "errors_total": 1, "retry_attempts": 6}


def test_hashing_embedder_is_a_unit_vector_of_whole_texts(spark):
    long = " ".join(f"w{i % 700}" for i in range(20_000))
    frame = spark.createDataFrame([(1, "a b a"), (2, long), (3, "...")], "id long, text string")
    vectors = {r.id: r.vector for r in embedding.hashing_embedder(256)(frame, "id", "text").collect()}
    assert set(vectors) == {1, 2}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 and len(v) == 256 for v in vectors.values())
    assert sorted(x for x in vectors[1] if x) == pytest.approx([5 ** -0.5, 2 * 5 ** -0.5])


def test_long_texts_are_handled_in_pieces(spark, monkeypatch):
    import pyarrow as pa
    texts = ["a b", None, "", "c " * 3000, "d", "E e-é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["k", "t"])
    for limit in (1, 100, 1 << 20):
        monkeypatch.setattr(embedding, "SLICE_BYTES", limit)
        pieces = list(embedding._slices(batch, 1))
        assert [x for p in pieces for x in p.column(1).to_pylist()] == texts
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = embedding.hashed_terms(frame, "k", "t").groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r.k: round(r.n, 9) for r in got} == {0: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_each_query_is_embedded_once(spark):
    rows = spark.createDataFrame([(i, f"query {i % 2}") for i in range(6)], "id int, query string")
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(len(batch))
        return [[float(len(t))] for t in batch]

    got = embedding.embed_queries(rows, embedding.model_embedder(model)).collect()
    assert len(got) == 6 and all(r.query_vector == [7.0] for r in got) and calls.value == 2


# -- corpus


def points(spark, rows):
    return spark.createDataFrame(
        [(i, "src", t, f"title {v}", "url", T0, T0 + dt.timedelta(hours=v), [float(v), 1.0]) for i, t, v in rows],
        "id string, source string, tickers array<string>, title string, content_url string, "
        "published_at timestamp, ingested_at timestamp, vector array<float>")


def test_payload(spark):
    got = corpus.payload(points(spark, [("a", ["X"], 1), ("b", [], 1), ("c", None, 1)])).orderBy("id").collect()
    assert [r.payload.tickers for r in got] == [["X"], None, None]
    assert {r.payload.published_at for r in got} == {"2024-01-01T00:00:00Z"}


def test_corpus_upsert_replay_and_compaction(spark, tmp_path):
    path, target = str(tmp_path / "points"), str(tmp_path / "compact")
    assert corpus.read_points(spark, path).count() == 0
    first = corpus.to_points(points(spark, [("a", [], 1), ("b", [], 1)]))
    second = corpus.to_points(points(spark, [("b", [], 2), ("c", [], 2)]))
    for batch, part in ((0, first), (1, second), (1, second), (0, first)):
        corpus.append_points(part, path, batch)
    state = [("a", [1.0, 1.0]), ("b", [2.0, 1.0]), ("c", [2.0, 1.0])]
    assert values(corpus.read_points(spark, path), "event_id", "vector") == state
    assert values(corpus.upsert_points(first, second), "event_id", "vector") == state
    assert values(corpus.read_points(spark, path, before=1), "event_id") == [("a",), ("b",)]
    corpus.compact(spark, path, target)
    assert values(corpus.read_points(spark, target), "event_id", "vector") == state
    stats = corpus.corpus_stats(corpus.read_points(spark, target)).first()
    assert tuple(stats) == (3, 2, 2)


def test_vector_guard(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "id string, vector array<float>")
    assert values(corpus.guard_vectors(rows, 2), "id", "vector_status") == [
        ("a", "ok"), ("b", "wrong_dim"), ("c", "missing")]


# -- registry tables


def strategies(spark):
    rows = [(f"s{i}", f"u{i % 2}", f"n{i}", "d", "q", [], ["T"], 0.5, i != 2, T0, T0) for i in range(4)]
    return spark.createDataFrame(rows, STRATEGY)


def requests(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, user_id string")


def alert_table(spark, n=4):
    rows = [(f"a{i}", f"u{i % 2}", f"s{i % 4}", f"e{i}", "t", "c", "url", 0.5 + i / 1000, False,
             T0 + dt.timedelta(minutes=i)) for i in range(n)]
    return spark.createDataFrame(rows, ALERT)


def test_stored_tables_are_read_under_their_schema(spark, tmp_path):
    strategies(spark).write.parquet(str(tmp_path / "s"))
    read = registry.read_table(spark, STRATEGY, path=str(tmp_path / "s"))
    assert read.schema == STRATEGY and values(read, "id") == [("s0",), ("s1",), ("s2",), ("s3",)]


@pytest.mark.parametrize("defaults, active", [(TABLE_DEFAULTS, True), (REQUEST_DEFAULTS, False)])
def test_insert_defaults_differ_by_path(spark, defaults, active):
    rows = spark.createDataFrame([("r", "u", None, None, None, None)],
                                 "request_id string, user_id string, source array<string>, tickers array<string>, "
                                 "similarity_threshold double, is_active boolean")
    row = registry.with_defaults(rows, defaults, F.lit(NOW)).first()
    assert (row.source, row.tickers, row.similarity_threshold, row.is_active) == ([], [], 0.0, active)
    assert row.created_at == row.updated_at == NOW


def test_toggle_update_and_reads(spark):
    rows = strategies(spark)
    asked = requests(spark, ("s0", "u0"), ("s1", "u0"), ("s2", "u0"), ("s3", "u1"), ("s3", "u1"))
    got = tables.toggle_strategies(rows, asked, F.lit(NOW))
    assert values(got, "id", "is_active", "updated_at") == [
        ("s0", False, NOW), ("s1", True, T0), ("s2", True, NOW), ("s3", True, NOW)]
    assert values(tables.not_found(rows, asked), "id") == [("s1",)]
    assert values(tables.owner_scoped_read(rows, asked), "id") == [("s0",), ("s2",), ("s3",)]
    updates = rows.where("id in ('s0', 's1')").withColumns({
        "name": F.lit("new"), "tickers": F.lit(None).cast("array<string>"), "user_id": F.lit("u0"), "v": F.lit(1)})
    newer = updates.withColumns({"name": F.lit("newer"), "v": F.lit(2)})
    got = tables.update_strategies(rows, updates.unionByName(newer), F.lit(NOW), "v")
    assert values(got, "id", "name", "tickers", "updated_at")[:2] == [("s0", "newer", None, NOW), ("s1", "n1", ["T"], T0)]
    assert [r.id for r in tables.user_strategies(rows, "u1").collect()] == ["s1", "s3"]


def test_deletes_and_cascade(spark):
    rows, sent = strategies(spark), alert_table(spark)
    asked = requests(spark, ("s0", "u0"), ("s1", "u0"))
    kept, left = tables.delete_strategies(rows, asked), tables.unlink_alerts(sent, rows, asked)
    assert values(kept, "id") == [("s1",), ("s2",), ("s3",)]
    assert values(left, "id", "strategy_id") == [("a0", None), ("a1", "s1"), ("a2", "s2"), ("a3", "s3")]
    users = spark.createDataFrame([("u0", "x"), ("u1", "y")], "id string, email string")
    parts = tables.cascade_delete_users(users, users.where("id = 'u0'"), rows, sent)
    assert [p.count() for p in parts] == [1, 2, 2]


def test_mark_read(spark):
    asked = requests(spark, ("a0", "u0"), ("a0", "u0"), ("a1", "u0"))
    got = tables.mark_alerts_read(alert_table(spark), asked)
    assert values(got, "id", "is_read") == [("a0", True), ("a1", False), ("a2", False), ("a3", False)]
    assert values(tables.not_found(alert_table(spark), asked), "id") == [("a1",)]


def test_api_keys(spark):
    stored = spark.createDataFrame([("k", "u0", "polygon", "old", T0)], API_KEY)
    asked = spark.createDataFrame(
        [("u0", "polygon", "new", NOW), ("u0", "other", "x", NOW), ("u1", "openai", "", NOW), ("u1", "openai", "k", NOW)],
        "user_id string, provider string, encrypted_key string, created_at timestamp")
    got = tables.upsert_api_keys(stored, asked)
    assert values(got, "user_id", "provider", "encrypted_key") == [("u0", "polygon", "new"), ("u1", "openai", "k")]
    users = spark.createDataFrame([("u0",), ("u1",), ("u2",)], "id string")
    status = tables.key_status(users, got)
    assert status.columns == ["user_id", "provider", "has_key"]
    assert values(status.where("has_key"), "user_id", "provider") == [("u0", "polygon"), ("u1", "openai")]
    assert status.count() == 6
    gone = spark.createDataFrame([("u0", "polygon"), ("u9", "openai")], "user_id string, provider string")
    assert values(tables.delete_api_keys(got, gone), "user_id") == [("u1",)]


def test_register_users(spark):
    users = spark.createDataFrame([("a@x",)], "email string")
    asked = spark.createDataFrame([("a@x", 1), ("b@x", 2), ("b@x", 3), ("c@x", 4)], "email string, seq int")
    inserted, rejected = tables.register_users(users, asked, "seq")
    assert values(inserted, "email", "seq") == [("b@x", 2), ("c@x", 4)]
    assert values(rejected, "email", "seq") == [("a@x", 1), ("b@x", 3)]
    assert values(tables.unique_violations(asked, "email"), "email", "rows") == [("b@x", 2)]


# -- alerts and sinks


def test_feed_buffer_and_pages(spark):
    busy = alert_table(spark, 300)
    feed = alerts.user_feed(busy).collect()
    assert {u: sum(r.user_id == u for r in feed) for u in ("u0", "u1")} == {"u0": 64, "u1": 64}
    first = json.loads(min((r for r in feed if r.user_id == "u0"), key=lambda r: r.seq).payload)
    assert first["id"] == "a0" and first["is_read"] is False and first["created_at"] == "2024-01-01T00:00:00Z"
    assert list(first) == ALERT.names
    page = [r.id for r in alerts.user_alerts_page(busy, "u1", 3, 2).collect()]
    assert page == ["a295", "a293", "a291"]
    assert len(alerts.user_alerts_page(busy, "u1").collect()) == 50
    every = alerts.alert_pages(busy, 3, 2).where("user_id = 'u1'").orderBy("position").collect()
    assert [r.id for r in every] == page
    assert alerts.user_alerts_page(busy, "nobody").collect() == []


def messages(spark):
    return spark.createDataFrame(
        [("s", "u", "watch", "o@x", "e", "A \"title\"\n", "src", None, 0.12345, 0.5)],
        "strategy_id string, user_id string, strategy_description string, recipient string, event_id string, "
        "event_title string, event_source string, event_url string, similarity_score double, similarity_threshold double")


def test_alert_log_line(spark):
    line = json.loads(alerts.alert_log(messages(spark)).first().value)
    assert line["similarity_score"] == "0.1235" and line["threshold"] == "0.50"
    assert line["event_title"] == 'A "title"\n' and line["recipient"] == "o@x"


def test_fan_out_reaches_every_sink_and_raises_the_first_error(spark, tmp_path):
    def broken(name):
        def sink(frame, batch_id):
            raise RuntimeError(name)
        return sink

    root, at = str(tmp_path), F.lit(NOW)
    sink_list = [broken("first"), sinks.table_sink(f"{root}/alerts", at), broken("second"),
                 sinks.log_sink(f"{root}/log"), sinks.feed_sink(f"{root}/feed", at)]
    for _ in range(2):  # a replay replaces its own output
        with pytest.raises(RuntimeError, match="first"):
            sinks.fan_out(messages(spark), 7, *sink_list)
    rows = read_parts(spark, f"{root}/alerts", ALERT)
    assert values(rows, "user_id", "content", "url", "is_read", "batch") == [("u", "watch", "", False, 7)]
    assert spark.read.text(f"{root}/log").count() == 1
    assert spark.read.json(f"{root}/feed").first().user_id == "u"
