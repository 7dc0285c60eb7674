"""Evaluation metrics over score tables.

A score table has one row per image and degradation view, with ``label`` (1 = generated)
and ``score``. Rows that could not be decoded are dropped first: Spark sorts NaN above
every number, so a NaN score would count as flagged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions.common import ColumnLike, col
from imgaudit.functions.verdicts import band
from imgaudit.operators.ranking import null_safe_join, running_counts
from imgaudit.operators.sampling import drop_failures
from imgaudit.session import stored


def is_fake() -> Column:
    return F.col("label") == 1


def is_real() -> Column:
    return F.col("label") == 0


def _share(condition: Column, among: Column) -> Column:
    return F.avg(F.when(among, condition.cast("double")))


def confusion(scores: DataFrame, threshold: float = fixed.FLAG_THRESHOLD,
              by: Sequence[str] = ("view",), score: str = "score") -> DataFrame:
    """Recall on generated, accuracy on real and their mean, at a fixed threshold."""
    value = F.col(score)
    return (drop_failures(scores, score).groupBy(*by)
            .agg(_share(value >= threshold, is_fake()).alias("tpr"),
                 _share(value < threshold, is_real()).alias("tnr"),
                 F.count(F.lit(1)).alias("n"))
            .withColumn("balanced_acc", (F.col("tpr") + F.col("tnr")) / 2))


def rate_by_source(scores: DataFrame, threshold: float = fixed.FLAG_THRESHOLD,
                   by: Sequence[str] = ("view",), score: str = "score") -> DataFrame:
    """Share of right verdicts per generator and per real source, worst first."""
    value = F.col(score)
    right = F.when(is_fake(), value >= threshold).otherwise(value < threshold)
    return (drop_failures(scores, score).groupBy(*by, "label", "source")
            .agg(F.avg(right.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
            .orderBy(*by, F.col("label").desc(), "rate", "source"))


def grid_rank(df: DataFrame, value: ColumnLike, grid: Sequence[float], name: str) -> DataFrame:
    """Add how many points of an evenly spaced grid are <= value.

    The first guess divides by the step; comparing with the grid itself then settles it,
    so a value equal to a grid point falls on the right side.
    """
    value, points = col(value), F.lit(list(grid))
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    guess = F.floor((value - F.lit(grid[0])) / F.lit(step))
    df = df.withColumn("_guess", F.least(F.greatest(guess, F.lit(0)),
                                         F.lit(len(grid) - 1)).cast("int"))

    def reached(i: Column) -> Column:
        return F.coalesce((F.get(points, i) <= value).cast("int"), F.lit(0))

    rank = F.col("_guess") + reached(F.col("_guess")) + reached(F.col("_guess") + 1)
    return df.withColumn(name, rank).drop("_guess")


def sweep_counts(ranked: DataFrame, rank: str, grid: Column, by: Sequence[str]) -> DataFrame:
    """Accuracy at every grid point from rows that carry their grid rank.

    Rows shrink to one count per (group, grid rank) before anything is summed up the grid.
    """
    counts = ranked.groupBy(*by, rank).agg(
        F.count_if(is_fake()).alias("_fake"), F.count_if(is_real()).alias("_real"))
    totals = counts.groupBy(*by).agg(F.sum("_fake").alias("_fakes"),
                                     F.sum("_real").alias("_reals"))
    points = totals.select(*by, "_fakes", "_reals", F.posexplode(grid).alias("_i", "threshold"))
    points = points.withColumn(rank, (F.col("_i") + 1).cast("int"))
    joined = null_safe_join(points, counts.withColumn(rank, F.col(rank).cast("int")),
                            [*by, rank], "left")
    above = Window.partitionBy(*by).orderBy(F.col("_i").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def reached(name):
        return F.sum(F.coalesce(F.col(name), F.lit(0))).over(above)

    return (joined
            .withColumns({"_fake_reached": reached("_fake"), "_real_reached": reached("_real")})
            .select(*by, F.col("_i").alias("i"), "threshold",
                    F.try_divide(F.col("_fake_reached"), F.col("_fakes")).alias("tpr"),
                    F.try_divide(F.col("_reals") - F.col("_real_reached"),
                                 F.col("_reals")).alias("tnr"))
            .withColumn("balanced_acc", (F.col("tpr") + F.col("tnr")) / 2))


def sweep_curve(scores: DataFrame, grid: Sequence[float] = fixed.EVAL_GRID,
                by: Sequence[str] = ("view",), score: str = "score") -> DataFrame:
    """Accuracy of every group at every threshold of an evenly spaced grid."""
    ranked = grid_rank(drop_failures(scores, score), score, grid, "_reached")
    return sweep_counts(ranked, "_reached", F.lit(list(grid)), by)


def first_best(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The lowest grid point with the highest balanced accuracy."""
    best = F.max_by(F.struct("threshold", "balanced_acc"),
                    F.struct(F.col("balanced_acc"), -F.col("i"))).alias("_best")
    return curve.groupBy(*by).agg(best).select(
        *by, F.col("_best.threshold").alias("best_threshold"),
        F.col("_best.balanced_acc").alias("best_balanced_acc"))


def threshold_sweep(scores: DataFrame, grid: Sequence[float] = fixed.EVAL_GRID,
                    by: Sequence[str] = ("view",), score: str = "score") -> DataFrame:
    return first_best(sweep_curve(scores, grid, by, score), by)


def roc_auc(scores: DataFrame, by: Sequence[str] = ("view",), score: str = "score") -> DataFrame:
    """Area under the ROC curve; a tie counts one half."""
    counts = running_counts(
        drop_failures(scores, score), score,
        {"fakes": F.count_if(is_fake()), "reals": F.count_if(is_real())}, by)
    won = F.col("fakes") * (F.col("reals_before") + F.col("reals") / 2)
    pairs = F.sum("fakes").cast("double") * F.sum("reals")
    return counts.groupBy(*by).agg(F.try_divide(F.sum(won), pairs).alias("auc"))


def metric_summary(scores: DataFrame, threshold: float = fixed.FLAG_THRESHOLD,
                   grid: Sequence[float] = fixed.EVAL_GRID, by: Sequence[str] = ("view",),
                   score: str = "score") -> DataFrame:
    """One row per view: fixed-threshold rates, AUC and the best threshold.

    What the scores come from is computed once; the three measures read three columns.
    """
    scores = stored(scores.select(*by, "label", score), "scores")
    rates = confusion(scores, threshold, by, score)
    for part in (roc_auc(scores, by, score), threshold_sweep(scores, grid, by, score)):
        rates = null_safe_join(rates, part, by)
    return rates


def compare_models(scores: DataFrame, tags: Sequence[str],
                   threshold: float = fixed.FLAG_THRESHOLD, score: str = "score") -> DataFrame:
    """Fixed-threshold rates side by side, one column group per model tag."""
    rates = confusion(scores, threshold, ("view", "model_tag"), score)
    return (rates.groupBy("view").pivot("model_tag", list(tags))
            .agg(F.first("balanced_acc").alias("balanced_acc"), F.first("tpr").alias("tpr"),
                 F.first("tnr").alias("tnr"), F.first("n").alias("n")))


def manifest_counts(manifest: DataFrame, by: Sequence[str] = ("subset",)) -> DataFrame:
    return manifest.groupBy(*by).agg(F.count_if(is_fake()).alias("fake"),
                                     F.count_if(~is_fake()).alias("real"))


def top_sources(manifest: DataFrame, n: int = 15) -> DataFrame:
    """The largest generators by kept rows."""
    return (manifest.filter(is_fake()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "source").limit(n))


def page_stats(responses: DataFrame, page: str = "page",
               threshold: float = fixed.FLAG_THRESHOLD) -> DataFrame:
    """Scored responses and flagged ones per page; works on a stream as well."""
    return responses.groupBy(page).agg(F.count("score").alias("analyzed"),
                                       F.count_if(F.col("score") >= threshold).alias("flagged"))


def site_rollup(observations: DataFrame, site: Sequence[str], order,
                threshold: float = fixed.FLAG_THRESHOLD) -> DataFrame:
    """Per site, over distinct urls: counts per band, second views and all scores.

    ``scores`` lists (score in thousandths, images), highest first. Scores are rounded to
    three decimals, so the list has at most 1001 entries and still holds every image.
    """
    rounded = F.floor(F.col("_seen.score") * 1000 + F.lit(0.5)).cast("int")
    first = F.min_by(F.struct("score", "tta"), F.struct(*[col(c) for c in order]))
    images = (observations.filter(F.col("score").isNotNull())
              .groupBy(*site, "url").agg(first.alias("_seen"))
              .select(*site, rounded.alias("milli"), F.col("_seen.tta").alias("tta")))
    flag, unsure = (int(round(t * 1000)) for t in (threshold, fixed.UNSURE_THRESHOLD))
    runs = images.groupBy(*site, "milli").agg(F.count(F.lit(1)).alias("n"),
                                              F.count_if("tta").alias("tta"))

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return runs.groupBy(*site).agg(
        F.sum("n").alias("n"),
        total(F.col("milli") >= flag).alias("flagged"),
        total(F.col("milli").between(unsure, flag - 1)).alias("unsure"),
        F.sum("tta").alias("tta_fired"),
        F.sort_array(F.collect_list(F.struct("milli", F.col("n").alias("images"))),
                     asc=False).alias("scores"))


def band_audit(scores: DataFrame, stored: str = "band",
               threshold: float = fixed.FLAG_THRESHOLD) -> DataFrame:
    """Stored bands against bands recomputed from the score."""
    expected = band("score", threshold)
    counted = scores.filter(F.col("score").isNotNull()).agg(
        *[F.count_if(F.col(stored) == b).alias(f"stored_{b.lower()}") for b in ("AI", "unsure")],
        *[F.count_if(expected == b).alias(f"expected_{b.lower()}") for b in ("AI", "unsure")])
    return counted.withColumns({
        "mismatch": (F.col("stored_ai") != F.col("expected_ai"))
        | (F.col("stored_unsure") != F.col("expected_unsure")),
        "no_unsure_sample": F.col("expected_unsure") == 0,
    })


def tta_audit(scores: DataFrame, low: float = 0.3, high: float = 0.8,
              min_side: int = fixed.TTA_MIN_SIDE) -> DataFrame:
    """Second views that fired against images clearly inside the uncertainty band."""
    clear = ((F.col("score") > low) & (F.col("score") < high)
             & (F.least("w", "h") >= min_side))
    return scores.agg(F.count_if("tta").alias("fired"),
                      F.count_if(clear).alias("in_band")).withColumn(
        "failed", (F.col("in_band") > 0) & (F.col("fired") == 0))


def average_params(checkpoints: DataFrame, n_checkpoints: int | Column | None = None) -> DataFrame:
    """Uniform element mean of parameters (ckpt, param, idx, value).

    With ``n_checkpoints`` given, an element missing from a checkpoint is an error.
    """
    mean = checkpoints.groupBy("param", "idx").agg(
        F.avg(F.col("value").cast("double")).alias("value"), F.count(F.lit(1)).alias("_n"))
    if n_checkpoints is not None:
        whole = F.assert_true(F.col("_n") == n_checkpoints,
                              F.concat(F.lit("parameter missing from a checkpoint: "), "param"))
        mean = mean.filter(whole.isNull())
    return mean.drop("_n")


def parity(ours: DataFrame, reference: DataFrame, max_ok: float = 0.2, mean_ok: float = 0.03,
           inclusive: bool = False) -> DataFrame:
    """Absolute score differences of files in both tables; passes below both bounds."""
    joined = ours.select("file", F.col("score").alias("_ours")).join(
        reference.select("file", F.col("score").alias("_theirs")), "file")
    out = joined.withColumn("_d", F.abs(F.col("_ours") - F.col("_theirs"))).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean"), F.max("_d").alias("max"),
        F.min_by("file", F.struct(-F.col("_d"), F.col("file"))).alias("worst"))
    within = (F.col("max") <= max_ok) if inclusive else (F.col("max") < max_ok)
    return out.withColumn("passed", (F.col("mean") < mean_ok) & within)
