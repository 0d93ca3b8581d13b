"""Checks of signed callbacks with Spark's own hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a hash takes at a time, by its bits.
BLOCK = {256: 64, 512: 128}


def hmac_of(key: bytes, message: Column, bits: int) -> Column:
    """HMAC as lower-case hex, of a key of at most a block: two nested hashes, each of a padded key and a text."""
    if len(key) > BLOCK[bits]:
        raise ValueError("the key is longer than a block")
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(BLOCK[bits], b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), bits))), bits)


def hmac_sha256(key: bytes, message: Column) -> Column:
    return hmac_of(key, message, 256)


def hmac_sha512(key: bytes, message: Column) -> Column:
    return hmac_of(key, message, 512)


def sorted_query(params: Column) -> Column:
    """A map of texts as `key=value&...` by rising key, values percent-encoded with + for blanks."""
    encoded = lambda v: F.replace(F.replace(F.url_encode(v), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), encoded(F.coalesce(e["value"], F.lit(""))))), "&")


def callback_signed(key: str, params: Column, signature: Column) -> Column:
    """A redirect's parameters under their HMAC-SHA512; without a key nothing is valid."""
    return F.coalesce(F.lower(signature) == hmac_sha512(key.encode(), sorted_query(params)), F.lit(False)) if key else F.lit(False)


def timed_signed(key: str, body: Column, header: Column) -> Column:
    """header is `t=time,v1=HMAC` in any order, the HMAC-SHA256 being that of the time, a dot and the body."""
    part = lambda name: F.regexp_extract(header, rf"(?:.*,)?{name}=([^,]*)", 1)
    expected = hmac_sha256(key.encode(), F.concat(part("t"), F.lit("."), body))
    return F.coalesce(part("v1") == expected, F.lit(False)) if key else F.lit(False)


def webhook_signed(key: str, body: Column, header: Column) -> Column:
    """header is `sha256=` and the HMAC of the body; without a key nothing is valid."""
    return F.coalesce(header == F.concat(F.lit("sha256="), hmac_sha256(key.encode(), body)), F.lit(False)) if key else F.lit(False)
