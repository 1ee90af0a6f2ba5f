"""Blocks of a registry: dealt, held and shipped, buckets, classes of equal filters and packed rows."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import matching, ranking, scoring
from tidewatch.streaming import matcher

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id string, source string, tickers array<string>, ingested_at timestamp, vector array<float>"
INTERESTS = "strategy_id string, wanted_sources array<string>, wanted_tickers array<string>, threshold double, query_vector array<float>"


def made(events, strategies, seed=1):
    g = random.Random(seed)
    vector = lambda: [g.uniform(-1, 1) for _ in range(6)]
    rows = [(f"e{i}", g.choice(["x", "y", None]), g.choice([None, ["A"], ["B", None], []]), T0 + dt.timedelta(seconds=g.randint(0, events)), vector())
            for i in range(events)]
    wanted = [(f"s{i}", [None, [], ["x"], [None]][i % 4], [None, ["A"], ["B", "A"]][i % 3], [0.0, -1.0][i % 2], vector()) for i in range(strategies)]
    return rows, wanted


def ranked(frame):
    return sorted((r.strategy_id, r.event_id, r.score, r["rank"]) for r in frame.collect())


def test_a_registry_dealt_to_tasks_matches_as_one_that_is_shipped(spark, monkeypatch):
    rows, wanted = made(500, 60)
    e, i = spark.createDataFrame(rows, EVENTS), spark.createDataFrame(wanted, INTERESTS)
    points = e.withColumnRenamed("event_id", "point_id")
    shipped = ranked(ranking.match_at_arrival(e, i)), sorted(map(tuple, ranking.vector_search(points, i).collect()))
    monkeypatch.setattr(scoring, "SHIPPED_BYTES", 0)
    dealt = ranked(ranking.match_at_arrival(e, i)), sorted(map(tuple, ranking.vector_search(points, i).collect()))
    assert dealt == shipped and len(dealt[0]) > 200


def test_many_small_blocks_do_not_copy_the_vectors(spark):
    """Vectors are shuffled once; only registry rows are copied, once per part."""
    rows, wanted = made(300, 60)
    scored = scoring.score_arrivals(spark.createDataFrame(rows, EVENTS), spark.createDataFrame(wanted, INTERESTS), max_block_bytes=400)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "CoGroup" not in plan
    assert scored.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_blocks_are_cut_by_bytes_in_order_of_filters(spark, monkeypatch):
    """A block that many strategies of equal filters share picks its vectors once."""
    rows, wanted = made(300, 60)
    batches = [pa.record_batch({"strategy_id": [w[0] for w in wanted[i:i + 25]], "wanted_sources": pa.array([w[1] or [] for w in wanted[i:i + 25]], pa.list_(pa.string())),
                                "wanted_tickers": pa.array([w[2] or [] for w in wanted[i:i + 25]], pa.list_(pa.string()))}) for i in (0, 25, 50)]
    size = [6 * 8 + 64 * (len(w[1] or []) + len(w[2] or [])) + 128 for w in wanted]
    for largest in (1, 500, 900, 10 ** 6):
        blocks = [[int(name[1:]) for name in block["strategy_id"].to_pylist()] for block in scoring._cut(iter(batches), 6, largest)]
        assert sum(blocks, []) == list(range(60))
        assert all(len(b) == 1 or sum(size[i] for i in b) <= largest for b in blocks)
        assert all(sum(size[i] for i in [*b, c[0]]) > largest for b, c in zip(blocks, blocks[1:]))
    i = spark.createDataFrame(wanted, INTERESTS)
    kinds = scoring._held_parts(spark.createDataFrame(rows, EVENTS).select("event_id", "source", "tickers", "vector"), scoring.measured(i).rows, 6, 900, "n long",
                                lambda block, parts: iter([pa.record_batch({"n": pa.array([len(block.bounds) - 1], pa.int64())})]), ()).collect()
    assert sum(r.n for r in kinds) < 2 * len(kinds)


def test_buckets_are_compared_where_blocks_meet(spark):
    rows, wanted = made(200, 12)
    g = random.Random(4)
    point = [(r[0], r[1], r[2], r[4], [float(g.randint(0, 4)) for _ in range(3)]) for r in rows]
    strategy = [(*w, [float(g.randint(0, 4)) for _ in range(3)]) for w in wanted]
    p = spark.createDataFrame(point, "point_id string, source string, tickers array<string>, vector array<float>, buckets array<double>")
    s = spark.createDataFrame(strategy, f"{INTERESTS}, buckets array<double>")
    plain = {(r.strategy_id, r.event_id): r.score for r in scoring.score_pairs(
        p.withColumnRenamed("point_id", "event_id"), s).collect()}
    met = {w[0]: sorted((-plain[w[0], r[0]], r[0]) for r in point if (w[0], r[0]) in plain and any(a == b for a, b in zip(w[5], r[4])))[:10] for w in strategy}
    got = ranking.top_points(scoring.score_buckets(p, s, 10), 10).collect()
    assert sorted((r.strategy_id, -r.score, r.point_id) for r in got) == sorted((name, *hit) for name, hits in met.items() for hit in hits)
    assert 50 < len(got) < len(plain)


def test_kinds_and_scores_of_a_part_as_row_by_row():
    """More filters than may share a product, null lists and one vector of length 0."""
    rows, wanted = made(80, 40)
    events = pa.table({"event_id": [r[0] for r in rows], "source": [r[1] for r in rows], "tickers": pa.array([r[2] for r in rows], pa.list_(pa.string())),
                       "vector": [[0.0] * 6 if n == 3 else r[4] for n, r in enumerate(rows)]})
    part = scoring._part_of(events)
    assert [part.kinds[code] for code in part.codes] == [(r[1], tuple(r[2] or ())) for r in rows]
    table = pa.table({"strategy_id": [w[0] for w in wanted], "wanted_sources": pa.array([w[1] for w in wanted], pa.list_(pa.string())),
                      "wanted_tickers": pa.array([w[2] for w in wanted], pa.list_(pa.string())), "threshold": [w[3] for w in wanted], "query_vector": [w[4] for w in wanted]})
    block = scoring._block_of(table)
    found = {(block.ids[int(s)].as_py(), rows[int(r)][0], x) for piece in scoring._reaching(block, part, scoring._All(40)) for s, r, x in zip(*piece)}
    scores = scoring._round6(block.units @ part.units.T)
    expected = {(block.ids[s].as_py(), rows[r][0], scores[s, r]) for s in range(40) for r in range(80)
                if block.mask(*part.kinds[part.codes[r]])[block.classes[s]]}
    assert found == expected and len(found) > 300


@pytest.mark.parametrize("lists", [[None, [], ["x"]], [["x", "y"], ["y", "x", "x"], [None]]])
def test_interests_of_equal_filters_count_as_many(spark, lists):
    rows, _ = made(60, 0)
    wanted = [(f"s{i}", lists[i % 3], [None, ["A"]][i % 2], 0.0, [1.0]) for i in range(30)]
    e, i = spark.createDataFrame(rows, EVENTS), spark.createDataFrame(wanted, INTERESTS)
    pairs = matching.prefilter_join(e, matching.alike(i))
    assert pairs.count() < matching.prefilter_join(e, i).count()
    count = lambda frame: sorted(map(tuple, matching.strategies_passed(frame).collect()))
    assert count(pairs) == count(matching.prefilter_join(e, i))


def test_neighbouring_rows_of_a_strategy_are_packed():
    batch = pa.RecordBatch.from_pydict({"strategy_id": ["a", "a", "b", "a"], "event_id": ["1", "2", "1", "3"],
                                        "ingested_at": [T0] * 4, "score": np.arange(4.0)})
    packed = next(matcher._packed(iter([batch])))
    assert packed["strategy_id"].to_pylist() == ["a", "b", "a"] and packed["events"].to_pylist() == [["1", "2"], ["1"], ["3"]]
    assert packed["scores"].to_pylist() == [[0.0, 1.0], [2.0], [3.0]]


def test_a_floor_and_vectors_that_are_not_numbers():
    g = np.random.default_rng(3)
    vectors = g.normal(size=(300, 6))
    vectors[::50, 0] = np.nan
    points = pa.table({"point_id": [f"p{n:03}" for n in range(300)], "source": ["x"] * 300, "tickers": pa.array([[]] * 300, pa.list_(pa.string())), "vector": vectors.tolist()})
    table = pa.table({"strategy_id": [f"s{n}" for n in range(12)], "wanted_sources": pa.array([None] * 12, pa.list_(pa.string())),
                      "wanted_tickers": pa.array([None] * 12, pa.list_(pa.string())), "threshold": [0.0] * 12, "query_vector": g.normal(size=(12, 6)).tolist()})
    block, scores = scoring._block_of(table), {}
    for number, strategy in enumerate(block.ids.to_pylist()):
        exact = scoring._round6(block.units[number] @ scoring._unit_rows(vectors).T)
        scores[strategy] = sorted((x for x in exact if x == x), reverse=True)
    floor = np.array([scores[s][4] for s in block.ids.to_pylist()])
    batches = points.to_batches(max_chunksize=100)
    found = pa.Table.from_batches(scoring._corpus_scores(block, scoring._parts(batches), 10, floor=floor)).to_pylist()
    assert {s: sorted((r["score"] for r in found if r["strategy_id"] == s), reverse=True) for s in scores} == {s: x[:5] for s, x in scores.items()}
    assert not {r["point_id"] for r in found} & {f"p{n:03}" for n in range(0, 300, 50)}


def test_vectors_are_packed_before_they_are_copied(spark, monkeypatch):
    """Packs keep all rows; vectors that need no order are not copied to every task."""
    rows, wanted = made(400, 40)
    e, i = spark.createDataFrame(rows, EVENTS), spark.createDataFrame(wanted, INTERESTS)
    packs = scoring._packed(e, 3).toArrow()
    assert 3 <= len(packs) <= 12  # a task's rows of a part fit in one
    back = pa.Table.from_batches(scoring._unpacked(packs.to_batches()))
    assert sorted(back["event_id"].to_pylist()) == sorted(r[0] for r in rows)
    monkeypatch.setattr(scoring, "PACK_BYTES", 2000)
    cut = list(scoring._sized(back.to_batches()))
    assert 5 < len(cut) < 60 and pa.Table.from_batches(cut).equals(back)
    assert [scoring._parts_for(*x) for x in [(1, 1), (8, 1), (12, 1), (12, 3), (12, 5), (12, 12)]] == [1, 2, 3, 3, 2, 1]
    monkeypatch.setattr(scoring, "SHIPPED_BYTES", 0)
    copies = []
    plain = scoring._copies
    monkeypatch.setattr(scoring, "_copies", lambda into: copies.append(into) or plain(into))
    points = e.withColumnRenamed("event_id", "point_id")
    found = sorted(map(tuple, ranking.vector_search(points, i).collect()))
    assert copies == [2, 2] and spark.sparkContext.defaultParallelism == 4
    monkeypatch.undo()
    assert found == sorted(map(tuple, ranking.vector_search(points, i).collect())) and len(found) > 100
