"""Batch twins of the verdict stream: what the cache and the retries would have done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.web import error_class
from imgaudit.operators.lookups import valid_cache
from imgaudit.operators.ranking import first_n, null_safe_join, order_value, packed, with_range


def dedupe_requests(events: DataFrame, order) -> DataFrame:
    """Add ``action`` and ``served``: a url is inferred until its first success, then cached."""
    position = order_value(order)
    ok = F.col("error").isNull() & F.col("score").isNotNull()
    first = events.filter(ok).groupBy("url").agg(
        F.min(position).alias("_since"), F.min_by("score", position).alias("_cached"))
    joined = events.join(first, "url", "left")
    cached = F.coalesce(position > F.col("_since"), F.lit(False))
    return joined.withColumns({
        "action": F.when(cached, "cached").otherwise("inferred"),
        "served": F.when(cached, F.col("_cached")).when(ok, F.col("score")),
    }).drop("_since", "_cached")


def newest_urls(events: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` urls whose first success is newest: (url, seq, score)."""
    ok = F.col("error").isNull() & F.col("score").isNotNull()
    entries = events.filter(ok).groupBy("url").agg(
        F.min(order).alias("seq"), F.min_by("score", order).alias("score"))
    return first_n(entries, "seq", n, last=True)


def snapshot_mirror(cache: DataFrame, version: Column | str | None, capacity: int) -> DataFrame:
    """The newest entries of a cache, stamped with the model version that made them."""
    version = version if isinstance(version, Column) else F.lit(version).cast("string")
    return first_n(cache, "seq", capacity, last=True).withColumn("model_version", version)


def restore_cache(cache: DataFrame, mirror: DataFrame, installed: Column | str | None,
                  key: str = "url") -> DataFrame:
    """A cache plus the mirror's valid entries whose key it does not hold yet.

    The key says what one entry is: a url, or the entry's number where urls may recur.
    """
    restored = valid_cache(mirror, installed).join(cache.select(key), key, "left_anti")
    return cache.unionByName(restored, allowMissingColumns=True)


def retry_plan(events: DataFrame, keys: Sequence[str], order, thrown: Column | None = None,
               earlier: DataFrame | None = None) -> DataFrame:
    """Add ``failures``, ``decision`` and ``delay_ms`` to ordered analysis attempts.

    ``failures`` counts transient errors since the key's last success. Up to three are
    retried, later each time; the fourth gives up. Permanent errors are not retried and a
    thrown message error is tried again at once; neither counts.

    ``earlier`` gives the failures a key already had, one row per key.

    Runs of failures are counted inside even ranges of the order and carried over from
    range to range, so one key's long history is spread over many tasks.
    """
    thrown = F.lit(False) if thrown is None else F.coalesce(thrown, F.lit(False))
    kind = F.when(thrown, "thrown").otherwise(error_class("error"))
    named = packed(events.withColumns({"_sort": order_value(order), "_kind": kind}), keys)
    df = with_range(named, "_sort")
    df = df.withColumns({"_ok": F.col("_kind").isNull().cast("int"),
                         "_bad": F.col("_kind").eqNullSafe("transient").cast("int")})
    inside = ["_key", "_range"]

    def up_to_here(*parts):
        return Window.partitionBy(*parts).rowsBetween(Window.unboundedPreceding, 0)

    df = df.withColumn("_run", F.sum("_ok").over(up_to_here(*inside).orderBy("_sort")))
    df = df.withColumn("_local", F.sum("_bad").over(up_to_here(*inside, "_run").orderBy("_sort")))

    ranges = df.groupBy(*inside).agg(F.max("_ok").alias("_reset"),
                                     F.max_by("_local", "_sort").alias("_tail"))
    ranges = ranges.withColumn(
        "_part", F.sum("_reset").over(up_to_here("_key").orderBy("_range")))
    ranges = ranges.withColumn(
        "_total", F.sum("_tail").over(up_to_here("_key", "_part").orderBy("_range")))
    before = Window.partitionBy("_key").orderBy("_range")
    carry = ranges.select(
        *inside, F.coalesce(F.lag("_total").over(before), F.lit(0)).alias("_carry"),
        (F.coalesce(F.lag("_part").over(before), F.lit(0)) > 0).alias("_succeeded"))

    failures = F.col("_local") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    decision = (F.when(F.col("_kind").isNull(), "ok")
                .when(F.col("_kind") == "permanent", "never")
                .when(F.col("_kind") == "thrown", "again")
                .when(F.col("failures") <= fixed.MAX_RETRIES, "retry").otherwise("give-up"))
    joined = df.join(carry, inside)
    if earlier is not None:
        known = earlier.select(*keys, F.col("failures").alias("_earlier"))
        joined = null_safe_join(joined, known, keys, "left").withColumn(
            "_carry", F.col("_carry") + F.when(F.col("_succeeded"), 0).otherwise(
                F.coalesce("_earlier", F.lit(0)))).drop("_earlier")
    out = joined.withColumn("failures", failures).withColumn("decision", decision)
    delay = F.when(F.col("decision") == "retry", F.col("failures") * fixed.RETRY_STEP_MS)
    return out.withColumn("delay_ms", delay).drop(
        "_sort", "_kind", "_ok", "_bad", "_run", "_local", "_carry", "_succeeded", "_range", "_key")
