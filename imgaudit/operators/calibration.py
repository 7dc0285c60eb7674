"""Quantiles of pooled logits and bias fitting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.operators.metrics import first_best, grid_rank, is_fake, is_real, sweep_counts
from imgaudit.operators.ranking import running_counts
from imgaudit.operators.sampling import drop_failures
from imgaudit.session import stored


def _neighbours(counts: DataFrame, z: str, probs: Sequence[float],
                extra: Sequence[str] = ()) -> DataFrame:
    """Per asked probability: the values at the two nearest positions, and the quantile.

    Out of running counts of distinct values, first the ranges that hold the positions are
    found, then the values; no task sees more than a range of them. ``extra`` columns of
    both values come along, as ``_a_*`` and ``_b_*``.
    """
    ranges = counts.groupBy("_range").agg(F.min("n_before").alias("_first"),
                                          F.sum("n").alias("_size"))
    asked = ranges.agg((F.sum("_size") - 1).alias("_last")).select(
        "_last", F.posexplode(F.lit(list(probs))).alias("i", "prob")).withColumn(
        "_at", F.col("prob") * F.col("_last"))
    asked = asked.withColumn("_low", F.floor("_at")).withColumn(
        "_high", F.least(F.col("_low") + 1, F.col("_last")))
    ranks = asked.select(F.explode(F.array("_low", "_high")).alias("r")).agg(
        F.collect_set("r")).scalar()

    def held(first, size):
        return lambda r: (r >= F.col(first)) & (r < F.col(first) + F.col(size))

    near = ranges.withColumn("_all", ranks).select(
        "_range", F.filter("_all", held("_first", "_size")).alias("_ranks")).filter(
        F.size("_ranks") > 0)
    picked = counts.join(near, "_range").select(
        F.struct(F.col(z).alias("z"), *extra).alias("_value"),
        F.explode(F.filter("_ranks", held("n_before", "n"))).alias("_r"))
    low = picked.select(F.col("_r").alias("_low"), F.col("_value").alias("_a"))
    high = picked.select(F.col("_r").alias("_high"), F.col("_value").alias("_b"))
    between = F.col("_at") - F.col("_low")
    a, b = F.col("_a.z"), F.col("_b.z")
    value = F.when(between >= 0.5, b - (b - a) * (F.lit(1.0) - between)).otherwise(
        a + (b - a) * between)
    return asked.join(low, "_low").join(high, "_high").select(
        "i", "prob", "_a", "_b", value.alias("quantile"))


def quantile_grid(df: DataFrame, z: str = "z",
                  probs: Sequence[float] = fixed.QUANTILE_PROBS) -> DataFrame:
    """Exact linearly interpolated quantiles: (i, prob, quantile)."""
    counts = stored(running_counts(drop_failures(df, z), z, {"n": F.count(F.lit(1))}), "counts")
    return _neighbours(counts, z, probs).select("i", "prob", "quantile")


def fit_bias(logits: DataFrame, target: float = fixed.FLAG_THRESHOLD, z: str = "z",
             view: str = "view", probs: Sequence[float] = fixed.QUANTILE_PROBS) -> DataFrame:
    """The bias that moves the best pooled operating point to the target threshold.

    One row: bias, z_star, pooled_balanced_acc, per_view. The candidates are quantiles, so
    what lies below each is read off the running counts of its neighbours, without another
    pass. ``sigmoid(z + bias) >= target`` is tested as ``z >= z_star``, which is the same
    and free of rounding.
    """
    kept = drop_failures(logits, z)
    classes = {"fakes": F.count_if(is_fake()), "reals": F.count_if(is_real())}
    counts = stored(running_counts(kept, z, {"n": F.count(F.lit(1)), **classes}), "counts")
    extra = [c for name in classes for c in (name, f"{name}_before")]
    totals = [F.sum(name) for name in classes]
    fakes, reals = (counts.select(total).scalar() for total in totals)

    def below(name):
        past = F.col(f"_b.{name}_before") + F.col(f"_b.{name}")
        return (F.when(F.col("quantile") <= F.col("_a.z"), F.col(f"_a.{name}_before"))
                .when(F.col("quantile") <= F.col("_b.z"), F.col(f"_b.{name}_before"))
                .otherwise(past))

    curve = _neighbours(counts, z, probs, extra).select(
        "i", F.col("quantile").alias("threshold"),
        ((F.try_divide(fakes - below("fakes"), fakes)
          + F.try_divide(below("reals"), reals)) / 2).alias("balanced_acc"))
    best = stored(first_best(curve), "best")
    z_star = best.select("best_threshold").scalar()
    accuracy = (F.avg(F.when(is_fake(), (F.col(z) >= F.col("z_star")).cast("double")))
                + F.avg(F.when(is_real(), (F.col(z) < F.col("z_star")).cast("double")))) / 2
    views = kept.select(view, "label", z).withColumn("z_star", z_star).groupBy(view).agg(
        accuracy.alias("acc"))
    per_view = views.agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(view, "acc"))))).scalar()
    logit = math.log(target / (1 - target))
    return best.select(
        (F.lit(logit) - F.col("best_threshold")).alias("bias"),
        F.col("best_threshold").alias("z_star"),
        F.col("best_balanced_acc").alias("pooled_balanced_acc"),
        per_view.alias("per_view"))


def bias_curve(logits: DataFrame, target: float = fixed.FLAG_THRESHOLD, z: str = "z",
               view: str = "view", biases: Sequence[float] = fixed.BIAS_GRID) -> DataFrame:
    """Accuracy of every view at every bias of an evenly spaced grid."""
    logit = math.log(target / (1 - target))
    cuts = [logit - b for b in reversed(biases)]
    ranked = grid_rank(drop_failures(logits, z), z, cuts, "_reached")
    curve = sweep_counts(ranked, "_reached", F.lit(cuts), [view])
    bias = F.get(F.lit(list(reversed(biases))), F.col("i"))
    return curve.withColumn("bias", bias).drop("i", "threshold")


def fit_bias_worst_view(logits: DataFrame, target: float = fixed.FLAG_THRESHOLD,
                        tnr_min: float = 0.95, z: str = "z", view: str = "view",
                        biases: Sequence[float] = fixed.BIAS_GRID) -> DataFrame:
    """The lowest bias with the best worst-view accuracy, real accuracy bounded in all views."""
    worst = bias_curve(logits, target, z, view, biases).groupBy("bias").agg(
        F.min("balanced_acc").alias("worst_balanced_acc"), F.min("tnr").alias("worst_tnr"))
    best = F.max_by(F.struct("bias", "worst_balanced_acc", "worst_tnr"),
                    F.struct(F.col("worst_balanced_acc"), -F.col("bias"))).alias("best")
    return worst.filter(F.col("worst_tnr") >= tnr_min).agg(best).select("best.*")
