"""Registry joins: active strategies and the event x strategy pre-filter.

Two narrow views are used from here on.  *Arrivals* carry (event_id, source, tickers,
...), *interests* carry (strategy_id, wanted_sources, wanted_tickers, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.predicates import is_empty

ANY = "any"
BROADCAST_BYTES = 64 << 20  # largest registry sent to every executor
SALTS = 16


def active_strategies(strategies: DataFrame, users: DataFrame) -> DataFrame:
    """Active strategies with their owner's address; a strategy without an owner drops out."""
    owners = users.select(F.col("id").alias("user_id"), F.col("email").alias("owner_email"))
    return strategies.where("is_active").join(owners, "user_id")


def interests(strategies: DataFrame, *extra: str) -> DataFrame:
    return strategies.select(
        F.col("id").alias("strategy_id"),
        F.col("source").alias("wanted_sources"),
        F.col("tickers").alias("wanted_tickers"),
        F.coalesce("similarity_threshold", F.lit(0.0)).alias("threshold"),
        *extra,
    )


def arrivals(events: DataFrame, *extra: str) -> DataFrame:
    return events.select(F.col("id").alias("event_id"), "source", "tickers", *extra)


def _event_keys(values: Column) -> Column:
    """The keys an event can be found under: the wildcard, and each of its own values."""
    own = F.transform(F.coalesce(F.array_distinct(values), F.array()), lambda v: F.concat(F.lit("="), v))
    return F.array_compact(F.concat(F.array(F.lit(ANY)), own))


def _interest_keys(wanted: Column) -> Column:
    """The keys an interest listens on: its distinct values, or the wildcard if it has none."""
    listed = F.transform(F.array_distinct(wanted), lambda v: F.concat(F.lit("="), v))
    return F.when(is_empty(wanted), F.array(F.lit(ANY))).otherwise(listed)


def _one_ticker_key(key: Column) -> Column:
    """Keep a pair once although several common tickers bring it together.

    Only the smallest common ticker counts, so no distinct over all pairs is needed.
    """
    smallest = F.array_min(F.array_intersect("tickers", "wanted_tickers"))
    return (key == ANY) | (key == F.concat(F.lit("="), smallest))


def _keyed_join(events: DataFrame, wanted: DataFrame, keys: list[str], salts: int | None) -> DataFrame:
    """Equi-join on the exploded keys.

    The registry is broadcast as a hash table if its measured size allows; only matching
    pairs are then touched and events are not shuffled.  Otherwise (or with ``salts``
    given) both sides are shuffled, and every key, above all the wildcard under which
    every event is found, is split over ``salts`` partitions: as many as the session shuffles
    into, so the wildcard's share of a partition shrinks as the cluster grows.  Only ids travel.
    """
    if salts is None and _bytes(wanted) <= BROADCAST_BYTES:
        return events.join(F.broadcast(wanted), keys)
    salts = salts or max(SALTS, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = events.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
    right = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, "_salt"]).drop("_salt")


def _bytes(wanted: DataFrame) -> int:
    """Size of the exploded registry, about: ids and keys, without rendering its rows."""
    width = F.octet_length("strategy_id") + 8 * (F.coalesce(F.size("wanted_sources"), F.lit(0))
                                                 + F.coalesce(F.size("wanted_tickers"), F.lit(0))) + 128
    return wanted.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def _by_source(events: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (events.withColumn("_s", F.explode(_event_keys(F.array("source")))),
            wanted.withColumn("_s", F.explode(_interest_keys(F.col("wanted_sources")))))


def _by_ticker(events: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (events.withColumn("_t", F.explode(_event_keys(F.col("tickers")))),
            wanted.withColumn("_t", F.explode(_interest_keys(F.col("wanted_tickers")))))


def source_join(events: DataFrame, wanted: DataFrame, salts: int | None = None) -> DataFrame:
    """Pairs that pass the source filter alone."""
    return _keyed_join(*_by_source(events, wanted), ["_s"], salts).drop("_s")


def ticker_join(events: DataFrame, wanted: DataFrame, salts: int | None = None) -> DataFrame:
    """Pairs that pass the ticker filter alone."""
    pairs = _keyed_join(*_by_ticker(events, wanted), ["_t"], salts)
    return pairs.where(_one_ticker_key(F.col("_t"))).drop("_t")


def prefilter_join(events: DataFrame, wanted: DataFrame, salts: int | None = None) -> DataFrame:
    """Pairs that pass both filters."""
    pairs = _keyed_join(*_by_ticker(*_by_source(events, wanted)), ["_s", "_t"], salts)
    return pairs.where(_one_ticker_key(F.col("_t"))).drop("_s", "_t")


def count_by_source(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many events pass each strategy's source filter: events are counted per source, then joined."""
    kinds = events.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return _weighed(source_join(kinds.withColumn("event_id", F.coalesce("source", F.lit(""))), wanted))


def count_by_tickers(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """How many events pass each strategy's ticker filter: events are counted per ticker set, then joined."""
    kinds = events.groupBy(F.array_sort(F.array_distinct("tickers")).alias("tickers")).agg(F.count(F.lit(1)).alias("n"))
    return _weighed(ticker_join(kinds.withColumn("event_id", F.coalesce(F.array_join("tickers", "|"), F.lit(""))), wanted))


def _weighed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("strategy_id").agg(F.sum("n").alias("events"))


def strategies_checked(events: DataFrame, active: DataFrame) -> DataFrame:
    """How many strategies each event is checked against: all active ones, before any filter."""
    total = active.agg(F.count(F.lit(1)).alias("strategies"))
    return events.select("event_id").join(F.broadcast(total), F.lit(True))  # one row


def alike(wanted: DataFrame) -> DataFrame:
    """Interests of equal filters as one, under the smallest id, and how many they are (``strategies``)."""
    def listed(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.coalesce(name, F.array().cast("array<string>")))).alias(name)

    return wanted.groupBy(listed("wanted_sources"), listed("wanted_tickers")).agg(
        F.coalesce(F.min("strategy_id"), F.lit("")).alias("strategy_id"), F.count(F.lit(1)).alias("strategies"))


def strategies_passed(pairs: DataFrame) -> DataFrame:
    """How many strategies each event was evaluated against after the pre-filter; events with none are absent.

    Pairs with interests made by ``alike`` count as many times as those stand for.
    """
    number = F.sum("strategies") if "strategies" in pairs.columns else F.count(F.lit(1))
    return pairs.groupBy("event_id").agg(number.alias("strategies"))
