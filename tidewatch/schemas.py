"""Fixed schemas of the data model.  Nothing is inferred."""

from pyspark.sql import types as T

_S, _D, _B, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_STRINGS, _VECTOR = T.ArrayType(_S), T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVENT = _struct(
    id=_S, source=_S, tickers=_STRINGS, title=_S, content_url=_S, raw_text=_S,
    published_at=_TS, ingested_at=_TS,
)
PAYLOAD = _struct(source=_S, title=_S, content_url=_S, published_at=_S, tickers=_STRINGS)
POINT = _struct(point_id=_S, event_id=_S, vector=_VECTOR, payload=PAYLOAD)
USER = _struct(id=_S, email=_S, password_hash=_S, created_at=_TS, updated_at=_TS)
API_KEY = _struct(id=_S, user_id=_S, provider=_S, encrypted_key=_S, created_at=_TS)
STRATEGY = _struct(
    id=_S, user_id=_S, name=_S, description=_S, query=_S, source=_STRINGS, tickers=_STRINGS,
    similarity_threshold=_D, is_active=_B, created_at=_TS, updated_at=_TS,
)
STRATEGY_REQUEST = _struct(
    name=_S, description=_S, query=_S, source=_STRINGS, tickers=_STRINGS,
    similarity_threshold=_D, is_active=_B,
)
ALERT = _struct(
    id=_S, user_id=_S, strategy_id=_S, event_id=_S, title=_S, content=_S, url=_S,
    similarity_score=_D, is_read=_B, created_at=_TS,
)
NEWS_ITEM = _struct(id=_S, tickers=_STRINGS, title=_S, article_url=_S, published_utc=_TS)
FILING_ENTRY = T.StructType([
    T.StructField("id", _S),
    T.StructField("title", _S),
    T.StructField("link", T.StructType([T.StructField("_href", _S)])),
    T.StructField("updated", _TS),
    T.StructField("published", _TS),
])
COMPANY = T.MapType(_S, T.StructType([
    T.StructField("cik_str", T.LongType()),
    T.StructField("ticker", _S),
    T.StructField("title", _S),
]))

# The two producers' source names and the key providers.
NEWS_SOURCE = "Polygon.io"
FILINGS_SOURCE = "SEC EDGAR"
PROVIDERS = ("polygon", "openai")

# Corpus dimension, hits per search, shortest text, feed buffer.
VECTOR_DIM = 1536
SEARCH_LIMIT = 10
MIN_TEXT_BYTES = 50
FEED_BUFFER = 64

# Registry defaults of the table, and of a JSON request that omits the field.
TABLE_DEFAULTS = {"similarity_threshold": 0.0, "is_active": True}
REQUEST_DEFAULTS = {"similarity_threshold": 0.0, "is_active": False}
FORM_DEFAULTS = {"similarity_threshold": 0.5, "is_active": True}

# Retry policy (milliseconds).
RETRY = {"max_retries": 3, "base_ms": 500, "max_ms": 10_000, "multiplier": 2.0}
