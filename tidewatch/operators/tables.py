"""Table maintenance as joins: requests in, new table version out.

Every operator takes the table and a frame of requests and returns the new version;
request frames may hold any number of rows and repeat a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.predicates import valid_key_request
from tidewatch.functions.scalars import uuid5_nil
from tidewatch.operators.corpus import latest_per_key
from tidewatch.schemas import PROVIDERS

OWNED = ["id", "user_id"]


def owner_scoped_read(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows asked for by their owner; a foreign or unknown id gives no row and no error."""
    return rows.join(requests.select(*OWNED), OWNED, "left_semi")


def not_found(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that name no row of their sender."""
    return requests.join(rows.select(*OWNED), OWNED, "left_anti")


def user_strategies(strategies: DataFrame, user_id: str) -> DataFrame:
    return strategies.where(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "id")


def toggle_strategies(strategies: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Flip is_active once per request; two toggles of one row cancel out."""
    flips = requests.groupBy(*OWNED).agg(F.count(F.lit(1)).alias("_flips"))
    asked, odd = F.col("_flips").isNotNull(), F.coalesce(F.col("_flips") % 2 == 1, F.lit(False))
    return (
        strategies.join(flips, OWNED, "left")
        .withColumns({
            "is_active": F.when(odd, ~F.col("is_active")).otherwise(F.col("is_active")),
            "updated_at": F.when(asked, now).otherwise(F.col("updated_at")),
        })
        .select(*strategies.columns)
    )


def update_strategies(strategies: DataFrame, updates: DataFrame, now: Column, version: str) -> DataFrame:
    """Replace every field of the owner's row; the newest of several updates counts."""
    fields = ["name", "description", "query", "source", "tickers", "similarity_threshold", "is_active"]
    newest = latest_per_key(updates, OWNED, F.col(version).desc())
    new = newest.select(*OWNED, F.struct(*fields).alias("_new"))
    hit = F.col("_new").isNotNull()
    replaced = {name: F.when(hit, F.col(f"_new.{name}")).otherwise(F.col(name)) for name in fields}
    return (
        strategies.join(new, OWNED, "left")
        .withColumns({**replaced, "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})
        .select(*strategies.columns)
    )


def delete_strategies(strategies: DataFrame, requests: DataFrame) -> DataFrame:
    return strategies.join(requests.select(*OWNED), OWNED, "left_anti")


def unlink_alerts(alerts: DataFrame, strategies: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts of the strategies these requests delete stay, without the link."""
    deleted = owner_scoped_read(strategies, requests).select(F.col("id").alias("strategy_id"))
    gone = deleted.withColumn("_gone", F.lit(True))
    return (
        alerts.join(gone, "strategy_id", "left")
        .withColumn("strategy_id", F.when(F.col("_gone").isNull(), F.col("strategy_id")))
        .select(*alerts.columns)
    )


def cascade_delete_users(users: DataFrame, deleted: DataFrame, *owned: DataFrame) -> list[DataFrame]:
    """The users table and every owned table without the deleted users' rows."""
    ids = deleted.select("id")
    owners = ids.withColumnRenamed("id", "user_id")
    return [users.join(ids, "id", "left_anti"), *(t.join(owners, "user_id", "left_anti") for t in owned)]


def mark_alerts_read(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    marks = requests.select(*OWNED).distinct().withColumn("_mark", F.lit(True))
    return (
        alerts.join(marks, OWNED, "left")
        .withColumn("is_read", F.col("is_read") | F.col("_mark").isNotNull())
        .select(*alerts.columns)
    )


def upsert_api_keys(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Newest valid key per (user, provider); its time replaces the old one.

    ``requests`` holds (user_id, provider, encrypted_key, created_at).  The row id is a
    function of the key pair, so it survives the update.
    """
    valid = requests.where(valid_key_request("provider", "encrypted_key")).withColumn(
        "id", uuid5_nil(F.concat_ws(":", "user_id", "provider")))
    merged = keys.unionByName(valid.select(*keys.columns))
    return latest_per_key(merged, ["user_id", "provider"], F.col("created_at").desc(), "encrypted_key")


def delete_api_keys(keys: DataFrame, requests: DataFrame) -> DataFrame:
    return keys.join(requests.select("user_id", "provider"), ["user_id", "provider"], "left_anti")


def key_status(users: DataFrame, keys: DataFrame) -> DataFrame:
    """(user_id, provider, has_key) for every user and provider; stored keys stay hidden."""
    offered = users.select(
        F.col("id").alias("user_id"), F.explode(F.array(*map(F.lit, PROVIDERS))).alias("provider"))
    held = keys.select("user_id", "provider").distinct().withColumn("_held", F.lit(True))
    return offered.join(held, ["user_id", "provider"], "left").select(
        "user_id", "provider", F.col("_held").isNotNull().alias("has_key"))


def register_users(users: DataFrame, requests: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(inserted rows, rejected rows): an address may exist once, the first request wins.

    ``requests`` holds (email, ``order``, ...), ``order`` telling the requests of one
    address apart.  The first per address is cut down inside each task, and rejects are
    found by (email, order), so an address asked for over and over stays spread out.
    """
    first = latest_per_key(requests, ["email"], F.col(order))
    inserted = first.join(users.select("email"), "email", "left_anti")
    rejected = requests.join(inserted.select("email", order), ["email", order], "left_anti")
    return inserted.select(*requests.columns), rejected.select(*requests.columns)


def unique_violations(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
