"""Column encryption: AES-256-GCM, base64 of nonce, ciphertext and tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.scalars import col


def _key_literal(key: str | bytes) -> Column:
    raw = key.encode("utf-8") if isinstance(key, str) else key
    if len(raw) != 32:
        raise ValueError(f"encryption key must be exactly 32 bytes (got {len(raw)})")
    return F.lit(bytearray(raw))


def encrypt(text: Column | str, key: str | bytes) -> Column:
    """A fresh random nonce per row, so equal texts give different results.

    Meant for stored columns: a literal is folded by the optimizer and sealed only once.
    """
    return F.base64(F.aes_encrypt(F.encode(col(text), "UTF-8"), _key_literal(key), F.lit("GCM")))


def decrypt(sealed: Column | str, key: str | bytes) -> Column:
    """Null when the key is wrong or the value was changed or is not base64."""
    raw = F.try_to_binary(col(sealed), F.lit("base64"))
    return F.decode(F.try_aes_decrypt(raw, _key_literal(key), F.lit("GCM")), "UTF-8")
