"""Scalar Column expressions: ids, formats, labels, vector arithmetic, back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schemas import RETRY


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def uuid5_nil(name: Column | str) -> Column:
    """UUID version 5 of ``name`` under the nil namespace, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit("0" * 32)), F.encode(col(name), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def alert_id(strategy_id: Column | str, event_id: Column | str) -> Column:
    """Deterministic alert id, so that a replay writes the same row."""
    return uuid5_nil(F.concat(col(strategy_id), F.lit(":"), col(event_id)))


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; a zero vector scores 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))


def rfc3339(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ssXXX")


def first_parenthesised(text: Column | str) -> Column:
    """Content of the first non-empty parenthesised group, null if there is none."""
    return F.nullif(F.regexp_extract(col(text), r"\(([^)]+)\)", 1), F.lit(""))


def parse_tickers(text: Column | str) -> Column:
    """``"aapl, msft,"`` -> ``["AAPL", "MSFT"]``."""
    parts = F.transform(F.split(col(text), ","), lambda t: F.upper(F.trim(t)))
    return F.filter(parts, lambda t: t != "")


def list_label(values: Column | str, empty: str = "All") -> Column:
    values = col(values)
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, ", ")).otherwise(empty)


def match_label(score: Column | str) -> Column:
    percent = F.floor(col(score) * 100 + 0.5).cast("bigint").cast("string")
    return F.concat(F.lit("Match: "), percent, F.lit("%"))


def match_colour(score: Column | str) -> Column:
    return F.when(col(score) > 0.8, "red").otherwise("orange")


def fixed_decimals(value: Column | str, places: int) -> Column:
    """``%.<places>f`` text.  Rounds half up on the value as stored (six decimals)."""
    exact = F.round(col(value).cast("decimal(18,6)"), places)
    return exact.cast(f"decimal(18,{places})").cast("string")


def retry_delay_ms(attempt: Column | str, policy: dict = RETRY) -> Column:
    """Back-off before the try that follows failed try number ``attempt`` (from 0)."""
    grown = F.lit(float(policy["base_ms"])) * F.pow(F.lit(float(policy["multiplier"])), col(attempt))
    return F.least(grown, F.lit(float(policy["max_ms"])))
