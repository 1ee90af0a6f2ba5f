"""Truth tables of the pre-filter, the match test and the validity rules."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import predicates as P
from tidewatch.operators import matching, ranking

NEWS, FILINGS = "Polygon.io", "SEC EDGAR"
PREFILTER = [
    (NEWS, ["AAPL"], None, None, True),
    (NEWS, None, [NEWS], None, True),
    (FILINGS, None, [NEWS], None, False),
    (FILINGS, None, [NEWS, FILINGS], None, True),
    (NEWS, ["AAPL"], None, ["AAPL"], True),
    (NEWS, ["GOOG"], None, ["AAPL"], False),
    (NEWS, ["TSLA", "AAPL"], None, ["AAPL", "MSFT"], True),
    (NEWS, None, None, ["AAPL"], False),
    (NEWS, ["AAPL"], [NEWS], ["AAPL"], True),
    (NEWS, ["GOOG"], [NEWS], ["AAPL"], False),
    (FILINGS, ["AAPL"], [NEWS], ["AAPL"], False),
    (FILINGS, ["AAPL"], None, ["AAPL"], True),
    (FILINGS, None, [FILINGS], None, True),
    # more: empty lists mean everything, case matters, repeated values, missing source
    (NEWS, [], [], [], True),
    (NEWS, ["aapl"], [], ["AAPL"], False),
    (NEWS, ["A", "B", "A"], [NEWS, NEWS], ["B", "A", "A"], True),
    (None, None, [NEWS], None, False),
    (None, None, None, None, True),
    (NEWS, ["any"], ["any"], ["any"], False),
    (NEWS, ["any"], None, ["any"], True),
]
SCHEMA = ("event_id string, source string, tickers array<string>, strategy_id string, "
          "wanted_sources array<string>, wanted_tickers array<string>, expected boolean")


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(f"e{i}", s, t, f"s{i}", ws, wt, x) for i, (s, t, ws, wt, x) in enumerate(PREFILTER)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_prefilter_truth_table(cases):
    got = cases.withColumn("got", P.prefilter("source", "tickers", "wanted_sources", "wanted_tickers"))
    assert got.where(~F.col("got").eqNullSafe(F.col("expected"))).collect() == []


@pytest.mark.parametrize("salts", [None, 3])
def test_join_gives_the_pairs_of_the_predicate(cases, salts):
    events = cases.select("event_id", "source", "tickers")
    wanted = cases.select("strategy_id", "wanted_sources", "wanted_tickers")
    brute = events.join(wanted, P.prefilter("source", "tickers", "wanted_sources", "wanted_tickers"))
    pairs = lambda df: sorted((r.event_id, r.strategy_id) for r in df.collect())
    assert pairs(matching.prefilter_join(events, wanted, salts)) == pairs(brute)
    single = events.join(wanted, P.source_passes("source", "wanted_sources"))
    assert pairs(matching.source_join(events, wanted, salts)) == pairs(single)
    single = events.join(wanted, P.tickers_pass("tickers", "wanted_tickers"))
    assert pairs(matching.ticker_join(events, wanted, salts)) == pairs(single)


@pytest.mark.parametrize("hits, threshold, expected", [
    ([("other", .95), ("abc", .85)], .80, .85),
    ([("abc", .80)], .80, .80),
    ([("abc", .50)], .80, None),
    ([("other", .95), ("more", .90)], .50, None),
    ([], .50, None),
    ([("abc", .01)], 0.0, .01),
])
def test_event_among_the_hits(spark, hits, threshold, expected):
    rows = spark.createDataFrame([("s", p, float(x), 1) for p, x in hits],
                                 "strategy_id string, point_id string, score double, rank int")
    events = spark.createDataFrame([("abc", "abc-123")], "point_id string, event_id string")
    interests = spark.createDataFrame([("s", threshold)], "strategy_id string, threshold double")
    got = [r.score for r in ranking.match_in_corpus(rows, events, interests).collect()]
    assert got == ([] if expected is None else [expected])


def test_float32_scores_are_widened_before_the_comparison(spark):
    rows = spark.createDataFrame([(0.7, 0.7), (0.8, 0.8)], "score double, threshold double")
    strict = rows.select(P.reaches_threshold_float32("score", "threshold")).collect()
    assert [r[0] for r in strict] == [False, True]
    assert [r[0] for r in rows.select(P.reaches_threshold("score", "threshold")).collect()] == [True, True]


def test_text_length_is_counted_in_bytes(spark):
    rows = spark.createDataFrame([("a" * 49,), ("a" * 50,), ("é" * 25,), ("é" * 24,), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(P.long_enough("t")).collect()] == [False, True, True, False, False, False]


def test_key_requests(spark):
    rows = spark.createDataFrame([("polygon", "k"), ("openai", ""), ("other", "k"), (None, "k"), ("openai", None)],
                                 "p string, k string")
    assert [r[0] for r in rows.select(P.valid_key_request("p", "k")).collect()] == [True, False, False, False, False]
