"""Ranks, positions and running counts that never gather one hot key in one task.

The order column is cut into ranges: rows are counted per (key, range), and the small
table of range totals gives each range its offset. Where every row needs its position,
rows are ranked inside their range. Where only the first (or last) n rows of a key
matter, just the one range that holds the n-th row is ranked, and only for keys that
have more than n rows. The ranges come from a repeatable sample of the order values
themselves, so they are even whatever the distribution and the same on a retried task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgaudit.functions.common import ColumnLike, col
from imgaudit.session import stored

MIN_RANGES = 32
SAMPLED = 32  # values per range that the cuts are chosen from


def order_value(order: ColumnLike | Sequence[ColumnLike]) -> Column:
    """One comparable value for one or several order columns."""
    if isinstance(order, (str, Column)):
        return col(order)
    parts = [col(c) for c in order]
    return parts[0] if len(parts) == 1 else F.struct(*parts)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b,
                       [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def packed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_key``: all keys as one value that is never null and equals itself.

    Windows, counts and joins on (``_key``, ``_range``) then share one shuffle, which a
    null-safe join on the keys themselves would not.
    """
    return df.withColumn("_key", F.struct(*keys) if keys else F.lit(0))


# ------------------------------------------------------------------ first n rows per key

def key_sizes(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keys and ``_rows``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def value_at_rank(df: DataFrame, order, targets: DataFrame,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Add ``_edge``: the order value at each key's 1-based rank ``_target``; null if none.

    Only the keys and the order columns of keys in ``targets`` are read. Rows are counted
    per range on the map side; the rows of one range per key are shuffled and ranked. Targets
    and edges, one row per key, are stored, as both are used more than once.
    """
    targets = stored(targets, "targets")
    narrow = packed(df.select(*keys, order_value(order).alias("_order")), keys)
    wanted = packed(targets, keys)
    if keys:
        rows = narrow.join(wanted.select("_key", "_target"), "_key")
    else:
        rows = narrow.withColumn("_target", targets.select("_target").scalar()).filter(
            F.col("_target").isNotNull())
    ranged = with_range(rows.select("_key", "_target", "_order"), "_order")
    totals = ranged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("n"),
                                                  F.first("_target").alias("_target"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("_target") - F.coalesce(F.sum("n").over(before), F.lit(0))
    held = totals.withColumn("_left", left).filter(
        (F.col("_left") > 0) & (F.col("_left") <= F.col("n"))).select("_key", "_range", "_left")
    near = ranged.select("_key", "_range", "_order").join(held, ["_key", "_range"])
    ranked = near.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_key", "_range").orderBy("_order")))
    found = ranked.filter(F.col("_rank") == F.col("_left")).select(
        "_key", F.col("_order").alias("_edge"))
    return stored(wanted.join(found, "_key", "left").drop("_key"), "edges")


def within_edge(df: DataFrame, order, edges: DataFrame, keys: Sequence[str] = (),
                last: bool = False, name: str = "_within") -> DataFrame:
    """Flag the rows up to their key's edge; keys without a target are inside as a whole."""
    value = order_value(order)
    if keys:
        df = null_safe_join(df, edges.select(*keys, "_target", "_edge"), keys, "left")
        target, edge = F.col("_target"), F.col("_edge")
    else:
        target, edge = (edges.select(c).scalar() for c in ("_target", "_edge"))
    inside = F.coalesce((value >= edge) if last else (value <= edge), F.lit(False))
    flagged = df.withColumn(name, F.when(target.isNull(), True).otherwise(inside))
    return flagged.drop("_target", "_edge") if keys else flagged


def first_n(df: DataFrame, order, n: int | Column, keys: Sequence[str] = (),
            last: bool = False) -> DataFrame:
    """The first (or last) n rows of every key, in an order without ties.

    ``n`` may depend on the keys. Wide columns such as image bytes are neither sorted nor
    shuffled: the cut-off value of each key that has more than n rows is found on the
    narrow columns and joined back as a filter.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    target = F.col("_rows") - n + 1 if last else n
    targets = key_sizes(df, keys).filter(F.col("_rows") > n).select(
        *keys, target.cast("bigint").alias("_target"))
    edges = value_at_rank(df, order, targets, keys)
    return within_edge(df, order, edges, keys, last).filter("_within").drop("_within")


# ------------------------------------------------------------------ even ranges of a value

def range_count(df: DataFrame) -> int:
    """How many ranges to cut: four per shuffle partition, as a power of two."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1 << (wanted - 1).bit_length(), MIN_RANGES)


def split_points(df: DataFrame, value: ColumnLike, ranges: int, unique: bool = False) -> Column:
    """A sorted array of ``ranges - 1`` values that cut the distinct values evenly.

    The sample is the values with the smallest hashes, hence the same on every run; it has
    many values for each range, and every so many-th of them is a cut.
    """
    values = df.select(col(value).alias("v")).filter(F.col("v").isNotNull())
    values = values if unique else values.distinct()
    sample = values.orderBy(F.xxhash64("v"), "v").limit(SAMPLED * ranges)
    ordered = sample.agg(F.array_sort(F.collect_list("v")).alias("vs"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get(
        F.col("vs"), F.floor(i * F.size("vs") / ranges).cast("int")))
    return ordered.select(cut).scalar()


def count_not_above(df: DataFrame, points: Column, value: ColumnLike, size: int,
                    name: str) -> DataFrame:
    """Add the number of sorted ``points`` (fewer than ``size``) that are <= value.

    A binary search folded over its step widths: one expression, which a filter on the
    result can copy without doubling it at every step.
    """
    steps = [1 << i for i in reversed(range((size - 1).bit_length()))]
    held = df.select("*", points.alias("_points"), col(value).alias("_value"))
    at = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(
        F.get("_points", at + step - 1) <= F.col("_value"), step).otherwise(0))
    return held.withColumn(name, at).drop("_points", "_value")


def with_range(df: DataFrame, order, unique: bool = True, name: str = "_range") -> DataFrame:
    """Add an even range number of the order value, for windows taken in two steps."""
    ranges = range_count(df)
    points = split_points(df, order_value(order), ranges, unique)
    return count_not_above(df, points, order_value(order), ranges, name)


def _range_starts(totals: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Running totals before every range; one row per key and range goes in."""
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    return totals.select(
        "_key", "_range",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_start") for c in counts])


def with_position(df: DataFrame, order, keys: Sequence[str] = (),
                  name: str = "position") -> DataFrame:
    """Add each row's 0-based position within its keys, in an order without ties."""
    df = packed(df.withColumn("_sort", order_value(order)), keys)
    ranged = with_range(df, "_sort")
    here = Window.partitionBy("_key", "_range").orderBy("_sort")
    local = ranged.withColumn("_row", F.row_number().over(here) - 1)
    totals = ranged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("n"))
    return (local.join(_range_starts(totals, ["n"]), ["_key", "_range"])
            .withColumn(name, F.col("_n_start") + F.col("_row"))
            .drop("_key", "_sort", "_range", "_row", "_n_start"))


def running_counts(df: DataFrame, value: str, counts: dict[str, Column],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: each count, and as ``<count>_before`` its total below the value.

    The distinct values are stored once, so the input is read once. ``_range`` stays: the
    even range of values each row was counted in.
    """
    grouped = df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])
    distinct = packed(stored(grouped, "distinct"), keys)
    ranged = with_range(distinct, value, unique=not keys)
    below = Window.partitionBy("_key", "_range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.withColumns(
        {f"_{n}_local": F.coalesce(F.sum(n).over(below), F.lit(0)) for n in counts})
    totals = ranged.groupBy("_key", "_range").agg(*[F.sum(n).alias(n) for n in counts])
    joined = local.join(_range_starts(totals, list(counts)), ["_key", "_range"])
    return joined.select(
        *keys, "_range", value, *counts,
        *[(F.col(f"_{n}_start") + F.col(f"_{n}_local")).alias(f"{n}_before") for n in counts])
