"""Small helpers shared by the column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def magic(hexadecimal: str) -> Column:
    return F.lit(bytes.fromhex(hexadecimal))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def round_half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")
