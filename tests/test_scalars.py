import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import scalars as X
from tidewatch.functions import secrets
from tidewatch.schemas import RETRY


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=30))
def test_uuid5(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(X.uuid5_nil("n")).collect()
    assert [r[0] for r in rows] == [str(uuid.uuid5(uuid.UUID(int=0), n)) for n in names]


def test_cosine_of_zero_vector_is_zero(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(X.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.5 ** 0.5) and got[1] == 0.0


def test_parse_tickers(spark):
    rows = spark.createDataFrame([(" aapl, msft ,,",), ("",), (",",)], "t string")
    assert [r[0] for r in rows.select(X.parse_tickers("t")).collect()] == [["AAPL", "MSFT"], [], []]


def test_first_parenthesised(spark):
    rows = spark.createDataFrame([("8-K - X (DE) (0001) (Filer)",), ("none",), ("() (7)",)], "t string")
    assert [r[0] for r in rows.select(X.first_parenthesised("t")).collect()] == ["DE", None, "7"]


def test_labels(spark):
    rows = spark.createDataFrame([(0.8,), (0.801,), (0.005,)], "s double")
    got = [tuple(r) for r in rows.select(X.match_label("s"), X.match_colour("s")).collect()]
    assert got == [("Match: 80%", "orange"), ("Match: 80%", "red"), ("Match: 1%", "orange")]
    text = rows.select(X.fixed_decimals("s", 4)).collect()
    assert [r[0] for r in text] == ["0.8000", "0.8010", "0.0050"]


@pytest.mark.parametrize("policy, waits", [
    (RETRY, [500, 1000, 2000, 4000, 8000, 10000, 10000]),
    ({"base_ms": 100, "multiplier": 10.0, "max_ms": 150}, [100, 150, 150]),
])
def test_retry_delay(spark, policy, waits):
    rows = spark.range(len(waits)).select(X.retry_delay_ms(F.col("id"), policy)).collect()
    assert [r[0] for r in rows] == waits


KEY = "k" * 32


def test_encryption_round_trip(spark):
    texts = ["", "a", "secret key", "é" * 40, "{}", "x" * 10_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("c", secrets.encrypt("t", KEY)).cache()
    assert [r[0] for r in rows.select(secrets.decrypt("c", KEY)).collect()] == texts
    assert [r[0] for r in rows.select(secrets.decrypt("c", "w" * 32)).collect()] == [None] * len(texts)
    sizes = rows.select(F.length(F.unbase64("c")) - F.octet_length("t")).collect()
    assert {r[0] for r in sizes} == {12 + 16}


def test_encryption_uses_a_fresh_nonce_and_rejects_damage(spark):
    same = spark.createDataFrame([("same",), ("same",)], "t string")
    rows = same.select(secrets.encrypt("t", KEY).alias("c")).collect()
    assert rows[0].c != rows[1].c
    bad = [rows[0].c[:-4] + "AAA=", "not base64!", "AAAA", ""]
    got = spark.createDataFrame([(b,) for b in bad], "c string").select(secrets.decrypt("c", KEY)).collect()
    assert [r[0] for r in got] == [None] * 4


@pytest.mark.parametrize("size", [5, 31, 33])
def test_encryption_key_length(spark, size):
    with pytest.raises(ValueError):
        secrets.encrypt(F.lit("x"), "k" * size)
