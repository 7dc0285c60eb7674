"""Choosing and grouping shard files before a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.operators.ranking import with_position


def even_sample(files: DataFrame, k: int, file: str = "file") -> DataFrame:
    """k evenly spaced files of the sorted listing, or all when there are no more than k."""
    placed = with_position(files, file)
    if k <= 0:
        return placed.drop("position")
    total = files.select(F.count(F.lit(1))).scalar()
    step = total / F.lit(float(k))
    guess = F.floor(F.col("position") / step)
    hit = F.lit(False)
    for i in (guess - 1, guess, guess + 1):  # the pick whose floor(i * step) is this position
        hit = hit | (i.between(0, k - 1) & (F.floor(i * step) == F.col("position")))
    return placed.filter((total <= k) | hit).drop("position")


def round_robin_groups(files: DataFrame, groups: int, file: str = "file") -> DataFrame:
    """Add ``gid``: files of the sorted listing dealt out in turn."""
    total: Column = files.select(F.count(F.lit(1))).scalar()
    placed = with_position(files, file)
    return placed.withColumn(
        "gid", F.pmod(F.col("position"), F.least(F.lit(groups), total))).drop("position")


def group_report(kept: DataFrame, gid: str = "gid") -> DataFrame:
    """Rows kept, distinct fake generators and reals per shard group."""
    fake = F.col("label") == 1
    return kept.groupBy(gid).agg(
        F.count(F.lit(1)).alias("kept"),
        F.count_distinct(F.when(fake, F.col("source"))).alias("fake_models"),
        F.count_if(~fake).alias("real"))
