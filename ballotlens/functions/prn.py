"""Pseudo-random numbers of cards, from built-in expressions only.

The number of the card with a given index is the absolute value of the last 8 bytes of
HMAC-SHA256(key = seed as 8 big-endian bytes, message = index + 1 as 4 big-endian bytes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(seed: int, byte: int) -> str:
    key = abs(seed).to_bytes(8, "big").ljust(64, b"\0")
    return bytes(b ^ byte for b in key).hex()


def prn(seed: int, index: Column) -> Column:
    message = F.lpad(F.hex((index + 1).cast("bigint")), 8, "0")
    inner = F.sha2(F.unhex(F.concat(F.lit(_pad(seed, 0x36)), message)), 256)
    outer = F.sha2(F.unhex(F.concat(F.lit(_pad(seed, 0x5C)), inner)), 256)
    return F.abs(F.conv(F.substring(outer, 49, 16), 16, -10).cast("bigint"))


def prn_sql(seed: int, index: str) -> str:
    """The same in DuckDB's SQL."""
    inner = f"sha256(unhex('{_pad(seed, 0x36)}' || lpad(to_hex({index} + 1), 8, '0')))"
    outer = f"sha256(unhex('{_pad(seed, 0x5C)}' || {inner}))"
    unsigned = f"('0x' || {outer}[49:64])::ubigint"
    return f"(case when {unsigned} > 9223372036854775807 then 18446744073709551616 - {unsigned}::hugeint else {unsigned}::hugeint end)::bigint"
