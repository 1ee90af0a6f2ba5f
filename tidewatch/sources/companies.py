"""Company dimension: CIK -> ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import COMPANY


def company_tickers(documents: DataFrame, body: str = "value") -> DataFrame:
    """JSON objects of company objects -> one (cik text, ticker) row per CIK.

    A CIK with several tickers takes the smallest, so the result does not depend on order.
    """
    entries = documents.select(F.explode(F.from_json(F.col(body), COMPANY)).alias("_key", "_company"))
    return (
        entries.where("_company.cik_str is not null")
        .groupBy(F.col("_company.cik_str").cast("string").alias("cik"))
        .agg(F.min("_company.ticker").alias("ticker"))
    )


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """The published company file: a single JSON object per file."""
    return company_tickers(spark.read.text(path, wholetext=True))
