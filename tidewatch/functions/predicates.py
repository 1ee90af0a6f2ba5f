"""Boolean Column expressions: the pre-filter, text length, threshold and validity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.scalars import col
from tidewatch.schemas import MIN_TEXT_BYTES, PROVIDERS


def is_empty(values: Column | str) -> Column:
    return F.coalesce(F.size(col(values)), F.lit(0)) <= 0


def source_passes(event_source: Column | str, wanted: Column | str) -> Column:
    """An empty list wants every source; otherwise exact, case-sensitive membership."""
    return is_empty(wanted) | F.coalesce(F.array_contains(col(wanted), col(event_source)), F.lit(False))


def tickers_pass(event_tickers: Column | str, wanted: Column | str) -> Column:
    """An empty list wants everything; otherwise at least one common ticker."""
    return is_empty(wanted) | F.coalesce(F.arrays_overlap(col(event_tickers), col(wanted)), F.lit(False))


def prefilter(event_source, event_tickers, wanted_sources, wanted_tickers) -> Column:
    return source_passes(event_source, wanted_sources) & tickers_pass(event_tickers, wanted_tickers)


def long_enough(text: Column | str, min_bytes: int = MIN_TEXT_BYTES) -> Column:
    """Length is counted in bytes, not characters; missing text is too short."""
    return F.coalesce(F.octet_length(col(text)), F.lit(0)) >= min_bytes


def reaches_threshold(score: Column | str, threshold: Column | str) -> Column:
    return col(score).cast("double") >= col(threshold)


def reaches_threshold_float32(score: Column | str, threshold: Column | str) -> Column:
    """The strict variant: the score is narrowed to float32 first, so 0.7 misses 0.7."""
    return col(score).cast("float").cast("double") >= col(threshold)


def filled(text: Column | str) -> Column:
    return F.coalesce(col(text), F.lit("")) != ""


def valid_key_request(provider: Column | str, key: Column | str) -> Column:
    return F.coalesce(col(provider).isin(*PROVIDERS), F.lit(False)) & filled(key)
