"""Ranking against brute force, under skew, in every plan."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.operators import ranking, scoring

T0 = dt.datetime(2024, 1, 1)
SCORED = "strategy_id string, event_id string, ingested_at timestamp, score double"
EVENTS = ("event_id string, source string, tickers array<string>, ingested_at timestamp, vector array<float>")
INTERESTS = ("strategy_id string, wanted_sources array<string>, wanted_tickers array<string>, "
             "threshold double, query_vector array<float>")


def brute_rank(rows, k, seed=()):
    """rows: (strategy, event, time, score)"""
    found = set()
    past = {}
    for strategy, score in seed:
        past.setdefault(strategy, []).append(score)
    for strategy, event, _, score in sorted(rows, key=lambda r: (r[2], r[1])):
        scores = past.setdefault(strategy, [])
        rank = 1 + sum(s > score for s in scores)
        if rank <= k:
            found.add((strategy, event, score, rank))
        scores.append(score)
    return found


def ranked(df):
    return {(r.strategy_id, r.event_id, r.score, r["rank"]) for r in df.collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.integers(0, 6)), min_size=1, max_size=60),
    k=st.integers(1, 3), seed=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6)), max_size=4),
)
def test_rank_at_arrival_is_brute_force(spark, rows, k, seed):
    rows = [(s, f"e{i:03d}", T0 + dt.timedelta(seconds=t), x / 10) for i, (s, t, x) in enumerate(rows)]
    seed = [(s, x / 10) for s, x in seed]
    best = {}
    for s, x in seed:
        best[s] = sorted([*best.get(s, []), x])[-k:]
    kept = [(s, x) for s, xs in best.items() for x in xs]
    start = spark.createDataFrame(kept, "strategy_id string, score double") if kept else None
    got = ranked(ranking.rank_at_arrival(spark.createDataFrame(rows, SCORED), k, start))
    assert got == brute_rank(rows, k, seed)


@pytest.mark.parametrize("shape", ["random", "rising", "falling", "equal"])
def test_one_strategy_holding_most_rows_at_one_instant(spark, shape):
    """The busy strategy is split over partitions and still ranked exactly."""
    rng = random.Random(1)
    score = {"random": lambda i: round(rng.random(), 6), "rising": lambda i: i / 1e5,
             "falling": lambda i: -i / 1e5, "equal": lambda i: 0.5}[shape]
    rows = [("busy", f"e{i:06d}", T0, score(i)) for i in range(6000)]
    rows += [(f"s{i % 50}", f"e{i:06d}", T0 + dt.timedelta(seconds=i), round(rng.random(), 6)) for i in range(3000)]
    frame = spark.createDataFrame(rows, SCORED)
    spread = frame.repartitionByRange(*ranking._ORDER).where("strategy_id = 'busy'")
    assert spread.select(ranking.F.spark_partition_id()).distinct().count() > 1
    # brute force by the running best, as the full count is quadratic
    found, past = set(), {}
    for strategy, event, _, x in sorted(rows, key=lambda r: (r[2], r[1])):
        best = past.setdefault(strategy, [])
        above = sum(s > x for s in best)
        if above < 10:
            found.add((strategy, event, x, above + 1))
            past[strategy] = sorted([*best, x])[-10:]
    assert ranked(ranking.rank_at_arrival(frame)) == found


def make_events(n, seed=3, dim=8):
    rng = random.Random(seed)
    events, interests = [], []
    for i in range(n):
        vector = [rng.uniform(-1, 1) for _ in range(dim)] if i % 17 else [0.0] * dim
        events.append((f"e{i}", rng.choice(["x", "y"]), rng.sample(["A", "B", "C"], rng.randint(0, 2)),
                       T0 + dt.timedelta(seconds=rng.randint(0, n // 3)), None if i % 29 == 5 else vector))
    for i in range(25):
        interests.append((f"s{i}", [["x"], [], None][i % 3], [["A", "C"], [], None, ["B"]][i % 4],
                          [0.0, 0.2, -1.0][i % 3], None if i == 7 else [rng.uniform(-1, 1) for _ in range(dim)]))
    return events, interests


def brute_pairs(events, interests):
    rows = []
    for e, source, tickers, t, v in events:
        for s, sources, wanted, threshold, q in interests:
            if v is None or q is None or (sources and source not in sources):
                continue
            if wanted and not set(wanted) & set(tickers):
                continue
            norm = (sum(x * x for x in map(f32, v)) * sum(x * x for x in map(f32, q))) ** 0.5
            score = sum(f32(a) * f32(b) for a, b in zip(v, q)) / norm if norm else 0.0
            rows.append((s, e, t, round(score, 6) + 0.0, threshold))
    return rows


def f32(x):
    import numpy as np
    return float(np.float32(x))


@pytest.mark.parametrize("max_block_bytes", [scoring.BLOCK_BYTES, 600])
def test_match_and_search_equal_brute_force(spark, max_block_bytes):
    events, interests = make_events(400)
    e, i = spark.createDataFrame(events, EVENTS), spark.createDataFrame(interests, INTERESTS)
    pairs = brute_pairs(events, interests)
    expected = {r for r in brute_rank([p[:4] for p in pairs], 10)
                if r[2] >= {s[0]: s[3] for s in interests}[r[0]]}
    got = ranked(ranking.match_at_arrival(e, i, max_block_bytes=max_block_bytes))
    assert got == expected
    best = {}
    for s, p, _, x, _ in pairs:
        best.setdefault(s, []).append((-x, p))
    top = {(s, p, -x, n + 1) for s, hits in best.items() for n, (x, p) in enumerate(sorted(hits)[:10])}
    points = e.withColumnRenamed("event_id", "point_id")
    hits = ranking.vector_search(points, i, max_block_bytes=max_block_bytes)
    assert {(r.strategy_id, r.point_id, r.score, r["rank"]) for r in hits.collect()} == top


def test_scores_are_pruned_alike_whatever_the_batch_size(spark):
    events, interests = make_events(300, seed=9)
    e, i = spark.createDataFrame(events, EVENTS), spark.createDataFrame(interests, INTERESTS)
    results = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        results.append(ranked(ranking.match_at_arrival(e, i)))
    assert results[0] == results[1] and results[0]


@pytest.mark.parametrize("max_block_bytes", [scoring.BLOCK_BYTES, 400])
def test_nulls_and_odd_lengths_mean_the_same_everywhere(spark, max_block_bytes):
    """Block form, pair form and Column form agree on null sources, null elements and null lists."""
    from tidewatch.functions import predicates
    from tidewatch.operators import matching
    sources, tickers = [None, "x", "y"], [None, [], [None], ["A"], [None, "A"], ["A", "B"]]
    events = [(f"e{i}{j}", s, t, T0, [1.0, float(i)]) for i, s in enumerate(sources) for j, t in enumerate(tickers)]
    wanted = [None, [], [None], ["x"], [None, "x"]]
    filters = [None, [], [None], ["A"], [None, "B"]]
    interests = [(f"s{i}{j}", w, f, -1.0, [1.0, 0.5]) for i, w in enumerate(wanted) for j, f in enumerate(filters)]
    e = spark.createDataFrame([*events, ("odd", "x", ["A"], T0, [1.0, 2.0, 3.0])], EVENTS)
    i = spark.createDataFrame([*interests, ("odd", None, None, -1.0, [1.0])], INTERESTS)
    pairs = {(r.event_id, r.strategy_id) for r in scoring.score_pairs(e, i, max_block_bytes).collect()}
    plain = spark.createDataFrame(events, EVENTS), spark.createDataFrame(interests, INTERESTS)
    joined = {(r.event_id, r.strategy_id) for r in matching.prefilter_join(*plain).collect()}
    salted = {(r.event_id, r.strategy_id) for r in matching.prefilter_join(*plain, salts=3).collect()}
    condition = predicates.prefilter("source", "tickers", "wanted_sources", "wanted_tickers")
    column = {(r.event_id, r.strategy_id) for r in plain[0].join(plain[1], condition).collect()}
    assert pairs == joined == salted == column and len(pairs) > 50
    assert [r.event_id for r in scoring.misfits(e, "vector", 2).collect()] == ["odd"]
    assert [r.strategy_id for r in scoring.misfits(i, "query_vector", 2).collect()] == ["odd"]


def test_raising_thresholds_only_removes_alerts(spark):
    events, interests = make_events(300, seed=4)
    e = spark.createDataFrame(events, EVENTS)
    low = ranked(ranking.match_at_arrival(e, spark.createDataFrame(interests, INTERESTS)))
    raised = [(*r[:3], r[3] + 0.3, r[4]) for r in interests]
    high = ranked(ranking.match_at_arrival(e, spark.createDataFrame(raised, INTERESTS)))
    assert high < low and all(1 <= r[3] <= 10 for r in low)


def test_empty_inputs(spark):
    events, interests = make_events(5)
    e, i = spark.createDataFrame(events, EVENTS), spark.createDataFrame(interests, INTERESTS)
    assert ranked(ranking.match_at_arrival(e.limit(0), i)) == set()
    assert ranked(ranking.match_at_arrival(e, i.limit(0))) == set()
    assert ranking.vector_search(e.withColumnRenamed("event_id", "point_id").limit(0), i).collect() == []


def test_lsh_search_recall(spark):
    events, interests = make_events(600, seed=5)
    points = spark.createDataFrame(events, EVENTS).withColumnRenamed("event_id", "point_id")
    i = spark.createDataFrame(interests, INTERESTS)
    key = lambda df: {(r.strategy_id, r.point_id, r.score) for r in df.collect()}
    exact, near = key(ranking.vector_search(points, i)), key(ranking.vector_search(points, i, method="lsh"))
    assert len(near) == len(exact) and len(near & exact) / len(exact) > 0.8


def test_candidates_are_not_shuffled_again_to_meet_earlier_scores(spark):
    rows = [(f"s{i % 3}", f"e{i:04d}", T0 + dt.timedelta(seconds=i), (i * 37 % 100) / 100) for i in range(600)]
    found = ranking.rank_at_arrival(spark.createDataFrame(rows, SCORED), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan
    assert ranked(found) == brute_rank(rows, 5)
