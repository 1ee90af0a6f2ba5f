"""Stored tables and strategy requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.predicates import filled
from tidewatch.functions.scalars import uuid5_nil
from tidewatch.schemas import REQUEST_DEFAULTS, STRATEGY_REQUEST

_CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, schema: T.StructType, fmt: str = "parquet", path: str | None = None,
               **options) -> DataFrame:
    """A stored table under its fixed schema (files), or over JDBC with ``fmt="jdbc"``."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "jdbc" else reader.schema(schema).load(path)


def judge_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Parse request bodies; ``status`` is ok, bad_json or missing_field."""
    schema = T.StructType([*STRATEGY_REQUEST.fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = F.from_json(F.col(body), schema, options)
    status = (
        F.when(F.col("_r").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull(), "bad_json")
        .when(~(filled("_r.name") & filled("_r.query")), "missing_field")
        .otherwise("ok")
    )
    fields = [F.col(f"_r.{f.name}").alias(f.name) for f in STRATEGY_REQUEST.fields]
    return requests.withColumn("_r", parsed).withColumn("status", status).select(
        *requests.columns, "status", *fields
    )


def with_defaults(rows: DataFrame, defaults: dict, now, request_id: str = "request_id") -> DataFrame:
    """Insert defaults: id from (owner, request id), empty lists, times, field defaults.

    The id is a function of its request, so importing the same request twice makes
    the same row.
    """
    empty = F.array().cast("array<string>")
    filled_in = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    return rows.withColumns({
        "id": uuid5_nil(F.concat_ws(":", F.col("user_id"), F.col(request_id))),
        "source": F.coalesce("source", empty),
        "tickers": F.coalesce("tickers", empty),
        "created_at": now,
        "updated_at": now,
        **filled_in,
    })


def import_strategies(requests: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(new strategy rows, rejected requests with their reason)."""
    judged = judge_requests(requests)
    accepted = with_defaults(judged.where("status = 'ok'"), REQUEST_DEFAULTS, now)
    return accepted.drop("body", "status"), judged.where("status <> 'ok'").select(*requests.columns, "status")
