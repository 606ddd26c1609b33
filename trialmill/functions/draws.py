"""Portable pseudo-random draws: a pure function of a row key and a salt, so a retried task redraws the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, *salt: object) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(key-salt...)."""
    parts = [key.cast("string")] + [s.cast("string") if isinstance(s, Column) else F.lit(str(s)) for s in salt]
    digits = F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def pick(n: Column | int, key: Column, *salt: object) -> Column:
    """A zero-based index below ``n``."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(key, *salt) * size).cast("int")


def choose(items: Column, key: Column, *salt: object) -> Column:
    """One element of an array column; null for an empty array."""
    return F.get(items, pick(F.size(items), key, *salt))
