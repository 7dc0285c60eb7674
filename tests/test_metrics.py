"""Metrics and calibration against numpy."""

import math

import numpy as np
import pytest


from imgaudit import fixed_values as fixed
from imgaudit.operators import calibration, degenerate, metrics


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 1500
    label = (rng.random(n) < 0.7).astype(int)
    z = np.round(rng.normal(0.8 * label, 1.5), 2)
    view = rng.choice(["clean", "web", "hard"], n)
    return view, label, z


@pytest.fixture(scope="module")
def df(spark, table):
    view, label, z = table
    rows = [(str(v), int(y), float(x), "s") for v, y, x in zip(view, label, z)]
    rows += [("clean", 1, float("nan"), "s"), ("web", 0, None, "s")]
    return spark.createDataFrame(rows, "view string, label int, z double, source string").cache()


def accuracy(y, z, t):
    return ((z[y == 1] >= t).mean() + (z[y == 0] < t).mean()) / 2


def test_confusion_ignores_failed_rows(df, table):
    view, label, z = table
    for r in metrics.confusion(df, 0.3, score="z").collect():
        y, x = label[view == r.view], z[view == r.view]
        assert r.n == len(y)
        assert math.isclose(r.tpr, (x[y == 1] >= 0.3).mean())
        assert math.isclose(r.tnr, (x[y == 0] < 0.3).mean())


def test_sweep_and_first_best(df, table):
    view, label, z = table
    grid = fixed.linspace(-2.0, 3.0, 51)
    curve = {(r.view, r.i): r for r in metrics.sweep_curve(df, grid, score="z").collect()}
    best = {r.view: r for r in metrics.threshold_sweep(df, grid, score="z").collect()}
    for name in ("clean", "web", "hard"):
        y, x = label[view == name], z[view == name]
        expected = [accuracy(y, x, t) for t in grid]
        assert np.allclose([curve[name, i].balanced_acc for i in range(51)], expected)
        assert best[name].best_threshold == grid[int(np.argmax(expected))]


def test_grids_are_those_of_numpy():
    assert fixed.EVAL_GRID == np.linspace(0.01, 0.99, 197).tolist()
    assert fixed.VALIDATION_GRID == np.linspace(0.02, 0.98, 97).tolist()
    assert fixed.QUANTILE_PROBS == np.linspace(0.005, 0.995, 400).tolist()


def test_auc_counts_ties_half(df, table):
    view, label, z = table
    for r in metrics.roc_auc(df, score="z").collect():
        y, x = label[view == r.view], z[view == r.view]
        diff = x[y == 1][:, None] - x[y == 0][None, :]
        assert math.isclose(r.auc, (diff > 0).mean() + (diff == 0).mean() / 2)


def test_auc_without_one_class_is_null(df):
    only = metrics.roc_auc(df.filter("label = 1"), score="z").collect()
    assert all(r.auc is None for r in only)


def test_quantiles_match_numpy_exactly(df, table):
    _, _, z = table
    found = [r.quantile for r in calibration.quantile_grid(df).orderBy("i").collect()]
    assert found == np.quantile(z, fixed.QUANTILE_PROBS).tolist()


def test_fit_bias(df, table):
    view, label, z = table
    candidates = np.quantile(z, fixed.QUANTILE_PROBS)
    scores = [accuracy(label, z, t) for t in candidates]
    z_star = candidates[int(np.argmax(scores))]
    r = calibration.fit_bias(df).first()
    assert r.z_star == z_star
    assert math.isclose(r.bias, math.log(0.65 / 0.35) - z_star)
    assert math.isclose(r.pooled_balanced_acc, max(scores))
    for name, acc in r.per_view.items():
        assert math.isclose(acc, accuracy(label[view == name], z[view == name], z_star))


def test_fit_bias_worst_view(df, table):
    view, label, z = table
    best = None
    for bias in fixed.BIAS_GRID:
        cut = math.log(0.65 / 0.35) - bias
        per = [(accuracy(label[view == v], z[view == v], cut),
                (z[(view == v) & (label == 0)] < cut).mean()) for v in ("clean", "web", "hard")]
        if min(p[1] for p in per) >= 0.9:
            worst = min(p[0] for p in per)
            if best is None or worst > best[0]:
                best = (worst, bias)
    r = calibration.fit_bias_worst_view(df, tnr_min=0.9).first()
    assert (r.worst_balanced_acc, r.bias) == (pytest.approx(best[0]), best[1])


def test_parity_golden(spark):
    ours = [("a.jpg", 0.10), ("b.jpg", 0.50), ("c.jpg", 0.90), ("only-ours.jpg", 0.3)]
    theirs = [("a.jpg", 0.12), ("b.jpg", 0.45), ("c.jpg", 0.85), ("only-theirs.jpg", 0.3)]
    a, b = (spark.createDataFrame(x, "file string, score double") for x in (ours, theirs))
    r = metrics.parity(a, b, mean_ok=0.05).first()
    assert (r.n, r.passed) == (3, True)
    assert math.isclose(r.mean, 0.04) and math.isclose(r.max, 0.05)
    assert r.worst in ("b.jpg", "c.jpg")
    assert not metrics.parity(a, b, max_ok=0.04, mean_ok=0.05).first().passed


def test_average_params_needs_every_checkpoint(spark):
    rows = [("a", "w", 0, 1.0), ("b", "w", 0, 3.0), ("a", "w", 1, 5.0)]
    df = spark.createDataFrame(rows, "ckpt string, param string, idx long, value double")
    assert metrics.average_params(df.filter("idx = 0"), 2).first().value == 2.0
    with pytest.raises(Exception, match="missing from a checkpoint"):
        metrics.average_params(df, 2).collect()


def test_site_rollup_keeps_every_image(spark):
    rows = [("s", "u1", 0.7004, False, 1), ("s", "u1", 0.1, True, 2), ("s", "u2", 0.6496, True, 3),
            ("s", "u3", 0.7004, False, 4), ("s", "u4", None, False, 5)]
    df = spark.createDataFrame(rows, "site string, url string, score double, tta boolean, o int")
    r = metrics.site_rollup(df, ["site"], ["o"]).first()
    assert (r.n, r.flagged, r.unsure, r.tta_fired) == (3, 3, 0, 1)
    assert [(s.milli, s.images) for s in r.scores] == [(700, 2), (650, 1)]


def test_series_stats_spans_ranges(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {}
    for group, size in (("hot", 4000), ("cold", 30), ("flat", 50)):
        x = np.full(size, 9.0) if group == "flat" else np.cumsum(rng.normal(size=size))
        rows += [(group, len(rows) + i, float(v)) for i, v in enumerate(x)]
        cov = np.corrcoef(x[:-1], x[1:])[0, 1] if group != "flat" else 0.0
        expected[group] = (size, x.var(), cov)
    df = spark.createDataFrame(rows, "g string, o long, x double").repartition(4)
    for r in degenerate.series_stats(df, ["g"], "o", "x").collect():
        n, variance, correlation = expected[r.g]
        assert r.n == n
        assert math.isclose(r.variance, variance, rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(r.correlation, correlation, rel_tol=1e-6, abs_tol=1e-6)


def test_single_row_group_has_no_correlation(spark):
    df = spark.createDataFrame([("g", 1, 2.0)], "g string, o long, x double")
    r = degenerate.series_stats(df, ["g"], "o", "x").select(
        "*", degenerate.degenerate_reason().alias("reason")).first()
    assert r.correlation is None and r.reason == "flat"
