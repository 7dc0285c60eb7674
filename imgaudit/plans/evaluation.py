"""Metrics, sweeps, calibration, audits and model comparison."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.functions import verdicts
from imgaudit.operators import calibration, degenerate, lookups, metrics
from imgaudit.plans import views
from imgaudit.plans.registry import Tables, query, rounded
from imgaudit.plans.views import list_sql, score_sql, sql
from imgaudit.session import shared_dir
from imgaudit.sources import manifests, sinks


def scored(t: Tables, bias: float = 0.0) -> DataFrame:
    return views.scores(t).withColumn("score", verdicts.calibrated_score("z", 1.0, bias))


_SCORED = f"scored AS (SELECT *, {score_sql()} AS score FROM scores)"
_RATES = """avg(CASE WHEN label = 1 THEN CASE WHEN score >= 0.65e0 THEN 1e0 ELSE 0e0 END END) AS tpr,
    avg(CASE WHEN label = 0 THEN CASE WHEN score < 0.65e0 THEN 1e0 ELSE 0e0 END END) AS tnr,
    count(*) AS n"""


@query(sql("scores", f"""
    {_SCORED}, rates AS (SELECT view, {_RATES} FROM scored GROUP BY view)
    SELECT view, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, n,
        round((tpr + tnr)/2, 6) AS balanced_acc FROM rates"""))
def confusion(t: Tables) -> DataFrame:
    return rounded(metrics.confusion(scored(t)), "tpr", "tnr", "balanced_acc")


@query(sql("scores", f"""
    {_SCORED} SELECT view, label, source, count(*) AS n, round(avg(CASE
        WHEN (label = 1 AND score >= 0.65e0) OR (label <> 1 AND score < 0.65e0)
        THEN 1e0 ELSE 0e0 END), 6) AS rate FROM scored GROUP BY view, label, source"""))
def rate_by_source(t: Tables) -> DataFrame:
    return rounded(metrics.rate_by_source(scored(t)), "rate")


def _curve_sql(grid, value: str, by: str) -> str:
    group = f"{by}, " if by else ""
    return f"""
    grid AS (SELECT unnest({list_sql(grid)}) AS threshold, unnest(range({len(grid)})) AS i),
    curve AS (SELECT {group}i, threshold,
        sum(CASE WHEN label = 1 AND {value} >= threshold THEN 1 ELSE 0 END)
            / CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tpr,
        sum(CASE WHEN label = 0 AND {value} < threshold THEN 1 ELSE 0 END)
            / CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tnr
        FROM scored, grid GROUP BY {group}i, threshold)"""


def _best_sql(by: str = "view") -> str:
    return f"""best AS (SELECT * FROM (SELECT *, (tpr + tnr)/2 AS bal, row_number() OVER (
        PARTITION BY {by} ORDER BY (tpr + tnr)/2 DESC, i) AS rn FROM curve) WHERE rn = 1)"""


@query(sql("scores", f"""
    {_SCORED}, {_curve_sql(fixed.EVAL_GRID, "score", "view")}, {_best_sql()}
    SELECT view, threshold AS best_threshold, round(bal, 6) AS best_balanced_acc FROM best"""))
def threshold_sweep(t: Tables) -> DataFrame:
    return rounded(metrics.threshold_sweep(scored(t)), "best_balanced_acc")


@query(sql("scores", f"""
    {_SCORED}, {_curve_sql(fixed.VALIDATION_GRID, "score", "view")}
    SELECT view, threshold, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr FROM curve"""))
def sweep_curve(t: Tables) -> DataFrame:
    return rounded(metrics.sweep_curve(scored(t), fixed.VALIDATION_GRID).select(
        "view", "threshold", "tpr", "tnr"), "tpr", "tnr")


# a score is rounded where ties matter, since exp differs in the last bit between engines
_ROUNDED = _SCORED.replace(score_sql(), f"round({score_sql()}, 9)")
_AUC = """pairs AS (SELECT f.view, avg(CASE WHEN f.score > r.score THEN 1e0
        WHEN f.score = r.score THEN 0.5e0 ELSE 0e0 END) AS auc
    FROM scored f JOIN scored r ON f.view = r.view AND f.label = 1 AND r.label = 0 GROUP BY f.view)"""


@query(sql("scores", f"{_ROUNDED}, {_AUC} SELECT view, round(auc, 6) AS auc FROM pairs"))
def roc_auc(t: Tables) -> DataFrame:
    return rounded(metrics.roc_auc(rounded(scored(t), "score", digits=9)), "auc")


@query(sql("scores", f"SELECT path AS file, round({score_sql()}, 6) AS score FROM scores WHERE view = 'clean'"))
def read_scores(t: Tables) -> DataFrame:
    """Scores written as JSON by file and read back."""
    clean = scored(t).filter("view = 'clean'").select(F.col("path").alias("file"), "score")
    path = f"{shared_dir(t.spark, 'scores')}/scores"
    lists = clean.groupBy(F.pmod(F.xxhash64("file"), F.lit(64)).alias("part")).agg(
        F.collect_list(F.struct("file", "score")).alias("images"))
    lists.select("images").write.option("maxRecordsPerFile", 1).json(path)  # one array per file
    return rounded(manifests.read_scores(t.spark, path, "images"), "score")


@query(sql("scores", f"""
    {_ROUNDED}, rates AS (SELECT view, {_RATES} FROM scored GROUP BY view), {_AUC},
    {_curve_sql(fixed.EVAL_GRID, "score", "view")}, {_best_sql()}
    SELECT view, round(r.tpr, 6) AS tpr, round(r.tnr, 6) AS tnr, n,
        round((r.tpr + r.tnr)/2, 6) AS balanced_acc, round(auc, 6) AS auc,
        threshold AS best_threshold, round(bal, 6) AS best_balanced_acc
    FROM rates r JOIN pairs USING (view) JOIN best USING (view)"""))
def metric_summary(t: Tables) -> DataFrame:
    """One row per view, written as JSON and read back."""
    summary = metrics.metric_summary(rounded(scored(t), "score", digits=9))
    path = f"{shared_dir(t.spark, 'summary')}/summary"
    sinks.write_summary(summary, path)
    back = t.spark.read.schema(summary.schema).json(path)
    return rounded(back, "tpr", "tnr", "balanced_acc", "auc", "best_balanced_acc")


_PROBS = list_sql(fixed.QUANTILE_PROBS)
_QUANTILES = f"""
    ordered AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS r, count(*) OVER () - 1 AS last
        FROM scores),
    asked AS (SELECT i, prob, last, prob * last AS place, CAST(floor(prob * last) AS BIGINT) AS low
        FROM (SELECT unnest({_PROBS}) AS prob, unnest(range({len(fixed.QUANTILE_PROBS)})) AS i),
            (SELECT DISTINCT last FROM ordered)),
    ends AS (SELECT i, prob, place - low AS t, a.z AS a, b.z AS b FROM asked
        JOIN ordered a ON a.r = low JOIN ordered b ON b.r = least(low + 1, asked.last)),
    quantiles AS (SELECT i, prob, CASE WHEN t >= 0.5e0 THEN b - (b - a)*(1e0 - t)
        ELSE a + (b - a)*t END AS quantile FROM ends)"""


@query(sql("scores", f"""
    {_QUANTILES} SELECT CAST(i AS INT) AS i, prob, round(quantile, 9) AS quantile FROM quantiles"""))
def quantile_grid(t: Tables) -> DataFrame:
    return rounded(calibration.quantile_grid(views.scores(t)), "quantile", digits=9)


_LOGIT = math.log(0.65 / 0.35)


@query(sql("scores", f"""
    {_QUANTILES}, curve AS (SELECT i, quantile, avg(CASE WHEN label = 1 THEN
            CASE WHEN z >= quantile THEN 1e0 ELSE 0e0 END END) AS tpr,
        avg(CASE WHEN label = 0 THEN CASE WHEN z < quantile THEN 1e0 ELSE 0e0 END END) AS tnr
        FROM scores, quantiles GROUP BY i, quantile),
    best AS (SELECT quantile AS z_star, (tpr + tnr)/2 AS acc FROM curve ORDER BY acc DESC, i LIMIT 1)
    SELECT view, round({_LOGIT!r}e0 - any_value(z_star), 6) AS bias,
        round(any_value(z_star), 6) AS z_star, round(any_value(acc), 6) AS pooled_balanced_acc,
        round((avg(CASE WHEN label = 1 THEN CASE WHEN z >= z_star THEN 1e0 ELSE 0e0 END END)
            + avg(CASE WHEN label = 0 THEN CASE WHEN z < z_star THEN 1e0 ELSE 0e0 END END))/2, 6)
            AS view_balanced_acc
    FROM scores, best GROUP BY view"""))
def fit_bias(t: Tables) -> DataFrame:
    fitted = calibration.fit_bias(views.scores(t)).select(
        "bias", "z_star", "pooled_balanced_acc",
        F.explode("per_view").alias("view", "view_balanced_acc"))
    return rounded(fitted, "bias", "z_star", "pooled_balanced_acc", "view_balanced_acc")


_CUTS = [_LOGIT - b for b in reversed(fixed.BIAS_GRID)]


@query(sql("scores", f"""
    scored AS (SELECT view, label, z FROM scores), {_curve_sql(_CUTS, "z", "view")},
    worst AS (SELECT (600 - i - 300)/100e0 AS bias, min((tpr + tnr)/2) AS acc, min(tnr) AS tnr
        FROM curve GROUP BY i)
    SELECT bias, round(acc, 6) AS worst_balanced_acc, round(tnr, 6) AS worst_tnr
    FROM worst WHERE tnr >= 0.8e0 ORDER BY acc DESC, bias LIMIT 1"""))
def fit_bias_worst_view(t: Tables) -> DataFrame:
    return rounded(calibration.fit_bias_worst_view(views.scores(t), tnr_min=0.8),
                   "worst_balanced_acc", "worst_tnr")


@query(sql("verdict_events", """
    seen AS (SELECT *, row_number() OVER (PARTITION BY page, url ORDER BY event_id) AS rn
        FROM verdict_events WHERE score IS NOT NULL),
    images AS (SELECT page, CAST(floor(score*1000 + 0.5e0) AS INT) AS milli, event_id % 3 = 0 AS tta
        FROM seen WHERE rn = 1),
    runs AS (SELECT page, milli, count(*) AS n, count(*) FILTER (tta) AS tta FROM images
        GROUP BY page, milli)
    SELECT page, CASE WHEN page % 2 = 0 THEN 'ai-lean' ELSE 'real-lean' END AS kind,
        CAST(sum(n) AS BIGINT) AS n,
        CAST(sum(CASE WHEN milli >= 650 THEN n ELSE 0 END) AS BIGINT) AS flagged,
        CAST(sum(CASE WHEN milli >= 500 AND milli < 650 THEN n ELSE 0 END) AS BIGINT) AS unsure,
        CAST(sum(tta) AS BIGINT) AS tta_fired,
        string_agg(concat(milli, 'x', n), ',' ORDER BY milli DESC) AS scores
    FROM runs GROUP BY page"""))
def site_rollup(t: Tables) -> DataFrame:
    seen = views.verdict_events(t).withColumns({
        "tta": F.col("event_id") % 3 == 0,
        "kind": F.when(F.col("page") % 2 == 0, "ai-lean").otherwise("real-lean")})
    listed = F.array_join(F.transform("scores", lambda s: F.concat(
        s["milli"].cast("string"), F.lit("x"), s["images"].cast("string"))), ",")
    return metrics.site_rollup(seen, ["page", "kind"], ["event_id"]).withColumn("scores", listed)


_STORED = """CASE WHEN doc_id % 40 = 0 THEN 'low' WHEN score >= 0.65e0 THEN 'AI'
    WHEN score >= 0.5e0 THEN 'unsure' ELSE 'low' END"""


@query(sql("scores", f"""
    {_SCORED}, counted AS (SELECT count(*) FILTER ({_STORED} = 'AI') AS stored_ai,
        count(*) FILTER ({_STORED} = 'unsure') AS stored_unsure,
        count(*) FILTER (score >= 0.65e0) AS expected_ai,
        count(*) FILTER (score >= 0.5e0 AND score < 0.65e0) AS expected_unsure FROM scored)
    SELECT *, stored_ai <> expected_ai OR stored_unsure <> expected_unsure AS mismatch,
        expected_unsure = 0 AS no_unsure_sample FROM counted"""))
def band_audit(t: Tables) -> DataFrame:
    stored = F.when(F.col("doc_id") % 40 == 0, "low").otherwise(verdicts.band("score"))
    return metrics.band_audit(scored(t).withColumn("band", stored))


@query(sql("scores", f"""
    {_SCORED} SELECT count(*) FILTER (score BETWEEN 0.25e0 AND 0.85e0 AND least(w, h) >= 384) AS fired,
        count(*) FILTER (score > 0.3e0 AND score < 0.8e0 AND least(w, h) >= 384) AS in_band,
        false AS failed FROM scored"""))
def tta_audit(t: Tables) -> DataFrame:
    both = verdicts.selective_tta("z", "z_native", "w", "h")
    return metrics.tta_audit(scored(t).withColumn("tta", both["tta"]))


@query(sql("scores", f"""
    {_SCORED}, models AS (SELECT view, label, 'm1' AS tag, score FROM scored UNION ALL
        SELECT view, label, 'm2', {score_sql("coalesce(z_native, z)")} FROM scored),
    rates AS (SELECT view, tag, {_RATES} FROM models GROUP BY view, tag)
    SELECT a.view, round((a.tpr + a.tnr)/2, 6) AS m1_balanced_acc, round(a.tpr, 6) AS m1_tpr,
        round(a.tnr, 6) AS m1_tnr, a.n AS m1_n, round((b.tpr + b.tnr)/2, 6) AS m2_balanced_acc,
        round(b.tpr, 6) AS m2_tpr, round(b.tnr, 6) AS m2_tnr, b.n AS m2_n
    FROM rates a JOIN rates b ON a.view = b.view AND a.tag = 'm1' AND b.tag = 'm2'"""))
def compare_models(t: Tables) -> DataFrame:
    models = F.array(*[F.struct(F.lit(tag).alias("model_tag"), z.alias("zz")) for tag, z in (
        ("m1", F.col("z")), ("m2", F.coalesce("z_native", "z")))])
    both = views.scores(t).select("view", "label", F.inline(models)).withColumn(
        "score", verdicts.calibrated_score("zz"))
    compared = metrics.compare_models(both, ["m1", "m2"])
    return rounded(compared, *[f"{m}_{c}" for m in ("m1", "m2")
                               for c in ("balanced_acc", "tpr", "tnr")])


@query(sql("verdict_events", """
    SELECT page, count(score) AS analyzed, count(*) FILTER (score >= 0.65e0) AS flagged
    FROM verdict_events GROUP BY page"""))
def page_stats(t: Tables) -> DataFrame:
    return metrics.page_stats(views.verdict_events(t))


@query("""
    SELECT CAST(label AS VARCHAR) AS param, CAST(idx AS BIGINT) AS idx, round(avg(value), 6) AS value
    FROM (SELECT label, unnest(range(64)) AS idx, unnest(embedding) AS value FROM embeddings)
    GROUP BY label, idx""")
def average_params(t: Tables) -> DataFrame:
    elements = t.embeddings.select(F.col("label").cast("string").alias("param"),
                                   F.col("vec_id").alias("ckpt"),
                                   F.posexplode("embedding").alias("idx", "value"))
    return rounded(metrics.average_params(elements.withColumn("idx", F.col("idx").cast("bigint"))),
                   "value")


@query(sql("scores", f"""
    diffs AS (SELECT path AS file, abs({score_sql()} - {score_sql("z_native")}) AS d
        FROM scores WHERE view = 'clean' AND z_native IS NOT NULL)
    SELECT count(*) AS n, round(avg(d), 6) AS mean, round(max(d), 6) AS max,
        (SELECT file FROM diffs ORDER BY d DESC, file LIMIT 1) AS worst,
        avg(d) < 0.03e0 AND max(d) < 0.2e0 AS passed FROM diffs"""))
def parity(t: Tables) -> DataFrame:
    clean = views.clean_scores(t).withColumnRenamed("path", "file")
    ours = clean.withColumn("score", verdicts.calibrated_score("z"))
    theirs = clean.filter("z_native IS NOT NULL").withColumn(
        "score", verdicts.calibrated_score("z_native"))
    return rounded(metrics.parity(ours, theirs), "mean", "max")


_TAXONOMY = {f"src{k}": (k % 2, f"f{k % 5}") for k in range(20)}


@query(sql("scores", """
    SELECT path, CAST(k % 2 AS INT) AS label, concat('f', k % 5) AS source
    FROM (SELECT path, CAST(substr(split_part(split_part(path, '/', 2), '_', 1), 4) AS BIGINT) AS k
        FROM scores WHERE view = 'clean')"""))
def apply_taxonomy(t: Tables) -> DataFrame:
    return lookups.apply_taxonomy(views.clean_scores(t).select("path"), "path", _TAXONOMY)


@query(sql("scores", f"""
    SELECT path, view, z AS z_std, CASE WHEN hit THEN z + 0.1e0 END AS z_v1,
        CASE WHEN hit THEN z - 0.1e0 END AS z_v2, CASE WHEN hit THEN z_native END AS z_v3
    FROM (SELECT *, {score_sql(bias=0.88)} BETWEEN 0.25e0 AND 0.85e0 AS hit FROM scores)"""))
def join_extra_logits(t: Tables) -> DataFrame:
    standard = views.scores(t).select("path", "view", F.col("z").alias("z_std"))
    score = verdicts.calibrated_score("z", 1.0, 0.88)
    extras = views.scores(t).filter(verdicts.in_band(score)).select(
        "path", "view", (F.col("z") + 0.1).alias("z_v1"), (F.col("z") - 0.1).alias("z_v2"),
        F.col("z_native").alias("z_v3"))
    return lookups.join_extra_logits(standard, extras)


_STATS = """
    pairs AS (SELECT grp, x, lag(x) OVER (PARTITION BY grp ORDER BY ord) AS a FROM series),
    sums AS (SELECT grp, count(*) AS n, avg(x*x) - avg(x)*avg(x) AS variance, count(a) AS m,
        sum(a) AS sa, sum(CASE WHEN a IS NOT NULL THEN x END) AS sb, sum(a*x) AS sab,
        sum(a*a) AS saa, sum(CASE WHEN a IS NOT NULL THEN x*x END) AS sbb FROM pairs GROUP BY grp),
    stats AS (SELECT grp, n, variance, (sab/m - (sa/m)*(sb/m))
        / sqrt(greatest((saa/m - (sa/m)*(sa/m))*(sbb/m - (sb/m)*(sb/m)), 1e-9)) AS correlation
        FROM sums)"""


@query(sql("series", f"""
    {_STATS} SELECT grp, n, round(variance, 4) AS variance, round(correlation, 4) AS correlation
    FROM stats"""))
def series_stats(t: Tables) -> DataFrame:
    return rounded(degenerate.series_stats(views.series(t), ["grp"], "ord", "x"),
                   "variance", "correlation", digits=4)


@query(sql("series", f"""
    {_STATS} SELECT grp, CASE WHEN variance < 4 THEN 'flat' WHEN correlation < 0.15e0 THEN 'noise'
        END AS reason FROM stats"""))
def degenerate_reason(t: Tables) -> DataFrame:
    return degenerate.series_stats(views.series(t), ["grp"], "ord", "x").select(
        "grp", degenerate.degenerate_reason().alias("reason"))
