"""HMAC-SHA-256 as Column expressions, and the check of signed payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _xored(digits: Column, high: int, low: int) -> Column:
    """Hex digits of a block with every byte xored by one of these two hex digits."""
    plain = "0123456789ABCDEF"
    by = lambda n: F.translate(digits, plain, "".join(plain[i ^ n] for i in range(16)))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(2 * _BLOCK - 1), F.lit(2)), lambda i: F.concat(F.substring(by(high), i, F.lit(1)), F.substring(by(low), i + 1, F.lit(1))))
    return F.unhex(F.array_join(pairs, ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """Lower-case hex of the HMAC of a message; key and message are text or binary, null gives null."""
    key, message = key.cast("binary"), message.cast("binary")
    short = F.when(F.octet_length(key) > _BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), 2 * _BLOCK, "0")
    inner = F.unhex(F.sha2(F.concat(_xored(digits, 3, 6), message), 256))
    return F.when(key.isNotNull() & message.isNotNull(), F.sha2(F.concat(_xored(digits, 5, 12), inner), 256))


def is_signed(payload: Column, header: Column, secret: Column) -> Column:
    """Whether a header ``sha256=<hex>`` signs the payload; a missing or malformed one doesn't."""
    said = F.regexp_extract(F.coalesce(header, F.lit("")), r"^sha256=([0-9a-fA-F]{64})$", 1)
    return F.coalesce((said != "") & (F.lower(said) == hmac_sha256(secret, payload)), F.lit(False))
