"""Ranks, positions and running counts against brute force, with one hot key."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from imgaudit.operators import ranking

KEYS = ["hot"] * 6 + ["a", "b", None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    order = rng.sample(range(100000), 3000)
    return [(rng.choice(KEYS), o, rng.choice([0.5, rng.random()])) for o in order]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, x double").repartition(5).cache()


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("n", [1, 7, 5000])
def test_first_n(df, rows, n, last):
    kept = {(r.k, r.o) for r in ranking.first_n(df, "o", n, ["k"], last).collect()}
    expected = set()
    for key in set(KEYS):
        ordered = sorted((o for k, o, _ in rows if k == key), reverse=last)
        expected |= {(key, o) for o in ordered[:n]}
    assert kept == expected


def test_first_n_overall_by_two_columns(df, rows):
    kept = [(r.x, r.o) for r in ranking.first_n(df, ["x", "o"], 40).collect()]
    assert sorted(kept) == sorted((x, o) for _, o, x in rows)[:40]


def test_positions(df, rows):
    found = {(r.k, r.o): r.position for r in ranking.with_position(df, "o", ["k"]).collect()}
    for key in set(KEYS):
        ordered = sorted(o for k, o, _ in rows if k == key)
        assert [found[key, o] for o in ordered] == list(range(len(ordered)))


def test_positions_without_keys(df, rows):
    found = ranking.with_position(df, "o").orderBy("o").select("position").collect()
    assert [r.position for r in found] == list(range(len(rows)))


def test_running_counts(df, rows):
    counted = ranking.running_counts(df, "x", {"n": F.count(F.lit(1))}, ["k"]).collect()
    assert len(counted) == len({(k, x) for k, _, x in rows})
    for r in counted[:400]:
        assert r.n == sum(k == r.k and x == r.x for k, _, x in rows)
        assert r.n_before == sum(k == r.k and x < r.x for k, _, x in rows)


def test_ranges_are_even_and_repeat(df):
    ranged = ranking.with_range(df, "o")
    first, again = (sorted(map(tuple, ranged.select("o", "_range").collect())) for _ in range(2))
    assert first == again
    sizes = np.unique([r for _, r in first], return_counts=True)[1]
    assert len(sizes) == ranking.range_count(df) and sizes.max() < 3000 / 4


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40),
       st.lists(st.integers(-60, 60), min_size=1, max_size=20))
def test_count_not_above(spark, values, points):
    points = sorted(points)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    out = ranking.count_not_above(df, F.lit(points), "v", len(points) + 1, "n").collect()
    assert [r.n for r in out] == [sum(p <= r.v for p in points) for r in out]


@pytest.mark.parametrize("ranges", [32, 256])
def test_ranges_are_even(spark, ranges):
    """The largest range has less than twice the mean, for values of any distribution."""
    df = spark.range(60_000).selectExpr("pow(hash(id) % 1000 / 1000e0, 5) + id * 1e-9 AS x")
    points = ranking.split_points(df, "x", ranges, True)
    sizes = [r["n"] for r in ranking.count_not_above(df, points, "x", ranges, "at").groupBy("at").agg(
        F.count("*").alias("n")).collect()]
    assert len(sizes) == ranges and max(sizes) < 2 * 60_000 / ranges


def test_count_not_above_bears_filters(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 37)
    points = ranking.split_points(df, "x", 64)
    found = ranking.count_not_above(df, points, "x", 64, "at")
    everything = {r.id: r["at"] for r in found.collect()}
    assert {r.id for r in found.filter("at > 20").collect()} == {i for i, at in everything.items() if at > 20}
