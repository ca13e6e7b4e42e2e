"""Seeded order keys: a reproducible stand-in for random numbers.

``md5`` gives the same text in every engine and on every run, so that a
"random" choice depends on the seed and the row id alone, never on how rows
are spread over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *ids: Column | str) -> Column:
    """32 hex digits, uniform over the rows; ``seed:id[:id...]`` is hashed."""
    parts: list[Column] = [F.lit(str(seed))]
    for one in ids:
        parts.append(F.lit(":"))
        parts.append((F.col(one) if isinstance(one, str) else one).cast("string"))
    return F.md5(F.concat(*parts))


def hex_threshold(probability: float) -> str:
    """The 8-digit prefix below which a uniform key falls with this probability."""
    return format(int(probability * 2**32), "08x")


def happens(key: Column, probability: float) -> Column:
    """True for the given share of uniform keys."""
    if probability >= 1:
        return F.lit(True)
    return F.substring(key, 1, 8) < F.lit(hex_threshold(probability))


def hash_bucket(key: Column, digits: int = 3) -> Column:
    """Leading digits of a key: equal-sized buckets that follow the key's order."""
    return F.substring(key, 1, digits)


def hash_number(text: Column, start: int, digits: int, modulus: int) -> Column:
    """A number in ``0 .. modulus-1`` from some digits of the text's hash."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint") % modulus


def text_digest(text: Column) -> Column:
    """Short join key for long texts."""
    return F.sha2(text, 256)
