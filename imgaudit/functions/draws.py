"""Repeatable pseudo-random draws: the same key and seed give the same value on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imgaudit.functions.common import ColumnLike, col

DRAW_RANGE = 1 << 52  # 13 hexadecimal digits, exact in a double


def hash_order(key: ColumnLike, seed: int | str) -> Column:
    """A sort value that shuffles rows by key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")).cast("binary"))


def draw(key: ColumnLike, seed: int | str) -> Column:
    """A whole number in [0, 2^52)."""
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("bigint")


def draw_unit(key: ColumnLike, seed: int | str) -> Column:
    """A double in [0, 1)."""
    return draw(key, seed) / F.lit(float(DRAW_RANGE))


def draw_int(key: ColumnLike, seed: int | str, low: Column | int, high: Column | int) -> Column:
    """A whole number in [low, high], both ends included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return low + F.pmod(draw(key, seed), high - low + 1)
