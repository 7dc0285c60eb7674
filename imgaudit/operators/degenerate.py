"""Flat fills and pure noise, told apart from photographs by two statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgaudit.functions.common import ColumnLike, col
from imgaudit.operators.ranking import order_value, with_range
from imgaudit.session import small_batches

MIN_VARIANCE = 4.0
MIN_CORRELATION = 0.15
SUMS = ("n", "sum_x", "sum_xx", "m", "sum_a", "sum_b", "sum_ab", "sum_aa", "sum_bb")


def _pair_sums(a: Column, b: Column) -> dict[str, Column]:
    both = a.isNotNull()
    terms = {"m": F.lit(1), "sum_a": a, "sum_b": b, "sum_ab": a * b, "sum_aa": a * a,
             "sum_bb": b * b}
    return {name: F.sum(F.when(both, term)) for name, term in terms.items()}


def series_sums(df: DataFrame, group: Sequence[str], order, x: str,
                row: Sequence[str] = ()) -> DataFrame:
    """Per group: sums of x and of neighbouring pairs (x[i-1], x[i]) within a row.

    Neighbours are taken inside even ranges of the order; the pairs that span two ranges
    come from a table with the first and last value of each, so a group of any length is
    spread over many tasks.
    """
    keys = [*group, *row]
    ranged = with_range(df.select(*keys, order_value(order).alias("_o"), F.col(x).alias("_x")),
                        "_o")
    inside = Window.partitionBy(*keys, "_range").orderBy("_o")
    value = F.col("_x")
    pairs = ranged.withColumn("_a", F.lag("_x").over(inside))
    parts = pairs.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("sum_x"),
        F.sum(value * value).alias("sum_xx"),
        *[c.alias(n) for n, c in _pair_sums(F.col("_a"), value).items()],
        F.min_by("_x", "_o").alias("_first"), F.max_by("_x", "_o").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_range")
    parts = parts.withColumn("_a", F.lag("_last").over(across))
    seam = _pair_sums(F.col("_a"), F.col("_first"))
    totals = {n: F.coalesce(F.sum(n), F.lit(0)) for n in SUMS}
    for n, c in seam.items():
        totals[n] = totals[n] + F.coalesce(c, F.lit(0))
    return parts.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()])


def _divided(total: ColumnLike, count: ColumnLike) -> Column:
    return F.try_divide(col(total).cast("double"), col(count))


def with_statistics(sums: DataFrame) -> DataFrame:
    """Population variance and neighbour correlation from the sums."""
    mean, mean_a, mean_b = (_divided(s, n) for s, n in
                            (("sum_x", "n"), ("sum_a", "m"), ("sum_b", "m")))
    var_a = _divided("sum_aa", "m") - mean_a * mean_a
    var_b = _divided("sum_bb", "m") - mean_b * mean_b
    spread = F.sqrt(F.greatest(var_a * var_b, F.lit(1e-9)))
    return sums.withColumns({
        "variance": _divided("sum_xx", "n") - mean * mean,
        "correlation": (_divided("sum_ab", "m") - mean_a * mean_b) / spread,
    })


def series_stats(df: DataFrame, group: Sequence[str], order, x: str,
                 row: Sequence[str] = ()) -> DataFrame:
    return with_statistics(series_sums(df, group, order, x, row)).select(
        *group, "n", "variance", "correlation")


def degenerate_reason(variance: ColumnLike = "variance",
                      correlation: ColumnLike = "correlation") -> Column:
    """``flat``, ``noise`` or null."""
    return (F.when(col(variance) < MIN_VARIANCE, "flat")
            .when(col(correlation) < MIN_CORRELATION, "noise"))


def _luma_sums(row_step: Callable[[int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: [] for name in SUMS}
            shapes = zip(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
            for (height, width, channels), data in zip(shapes, batch.column(4)):
                pixels = np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width, channels)
                rows = pixels[::row_step(int(height))].astype(np.float64)
                if channels >= 3:  # stored blue, green, red
                    luma = 0.299 * rows[..., 2] + 0.587 * rows[..., 1] + 0.114 * rows[..., 0]
                else:
                    luma = rows[..., 0]
                a, b = luma[:, :-1], luma[:, 1:]
                for name, total in zip(SUMS, (
                        luma.size, luma.sum(), np.vdot(luma, luma), a.size, a.sum(), b.sum(),
                        (a * b).sum(), (a * a).sum(), (b * b).sum())):
                    found[name].append(float(total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.float64()) for v in found.values()]],
                names=["path", *SUMS])

    return run


def every_row(height: int) -> int:
    return 1


def image_stats(images: DataFrame, row_step: Callable[[int], int] = every_row) -> DataFrame:
    """Luma statistics of decoded images (path, height, width, channels, data).

    One image is one row. All pixel rows are read, or only every ``row_step(height)``-th.
    """
    schema = "path string, " + ", ".join(f"{name} double" for name in SUMS)
    small_batches(images.sparkSession)
    sums = images.select("path", "height", "width", "channels", "data").mapInArrow(
        _luma_sums(row_step), schema)
    return with_statistics(sums).select("path", "variance", "correlation")
