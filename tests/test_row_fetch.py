"""Rows fetched by file and row number: no payload in an exchange, the same rows as by joins."""

import random

import pytest
from pyspark.sql import functions as F

from imgaudit.operators import row_fetch, sampling
from imgaudit.sources.manifests import scan_shards

ADDRESS = ("file", "row_index")


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    """Five shards of very different sizes; one source has most rows."""
    root = str(tmp_path_factory.mktemp("shards"))
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), None if i % 13 == 0 else f"payload {i}" * 20)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "ord long, source string, payload string")
    for low, high in ((0, 10), (10, 1500), (1500, 1501), (1501, 2900), (2900, 3000)):
        df.filter((F.col("ord") >= low) & (F.col("ord") < high)).coalesce(1).write.mode("append").parquet(root)
    return scan_shards(spark, [root], ["ord", "source", "payload"])


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _moves_payload(df) -> bool:
    return any("Exchange" in line and "Broadcast" not in line for line in _plan(df).split("\n"))


def _ords(df):
    return sorted(r.ord for r in df.select("ord").collect())


@pytest.mark.parametrize("limit", [row_fetch.LIMIT, 2000])
def test_fetch_gives_the_picked_rows_and_tags(shards, limit):
    narrow = shards.select("ord", *ADDRESS)
    want = narrow.filter("ord % 7 = 0 or (ord > 200 and ord < 400)")
    tagged = want.withColumn("split", F.when(F.col("ord") % 3 == 0, "a").otherwise("b")).drop("ord")
    twice = tagged.unionByName(tagged.limit(50))
    odd = shards.sparkSession.createDataFrame(
        [("no such file", 1, "a"), (None, 1, "a"), ("no such file", None, "b")], "file string, row_index long, split string")
    got = row_fetch.fetch(shards, twice.unionByName(odd), limit=limit)
    assert got.columns == [*shards.columns, "split"]
    rows = {r.ord: r for r in got.collect()}
    assert sorted(rows) == _ords(want) and got.count() == len(rows)
    payloads = {r.ord: r.payload for r in shards.collect()}
    assert all(r.payload == payloads[i] and r.split == ("a" if i % 3 == 0 else "b") for i, r in rows.items())


def test_words_stay_small(shards):
    words = row_fetch.picked_words(shards.select(*ADDRESS), *ADDRESS)
    assert words.count() <= sum(r.n for r in shards.groupBy("file").agg(
        F.ceil(F.count(F.lit(1)) / 64).alias("n")).collect())
    assert words.agg(F.sum(F.bit_count("_bits"))).first()[0] == 3000


def test_empty_choice(shards):
    none = shards.filter("ord < 0").select(*ADDRESS)
    assert row_fetch.fetch(shards, none).count() == 0
    assert row_fetch.fetch(shards.filter("ord < 0"), shards.select(*ADDRESS)).count() == 0


@pytest.mark.parametrize("needs", [None, "payload"])
def test_stride_without_moving_payloads(shards, needs):
    steps = {"hot": 7, "b": 2}
    plain = sampling.stride_sample(shards, steps, "ord", needs=needs)
    late = sampling.stride_sample(shards, steps, "ord", needs=needs, address=ADDRESS)
    by_place = sampling.stride_sample(shards, steps, ADDRESS, needs=needs, address=ADDRESS)
    assert late.columns == plain.columns
    assert _ords(late) == _ords(plain)
    assert by_place.count() > 0 and not _moves_payload(late) and not _moves_payload(by_place)


def test_curated_sources_without_moving_payloads(shards):
    specs = {"hot": sampling.Spec(3, 200, 40), "b": sampling.Spec(1, 60, 30, where=F.col("ord") > 100)}
    plain = sampling.curate_sources(shards, specs, "ord", "payload")
    late = sampling.curate_sources(shards, specs, "ord", "payload", address=ADDRESS)
    assert not _moves_payload(late)
    key = ["ord", "source", "payload", "split"]
    assert sorted(map(tuple, late.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))


def test_registered_queries_move_no_payload(spark):
    from imgaudit.plans.registry import QUERIES
    import __spark_entry__  # noqa: F401
    for name in ("stride_sample", "curate_sources"):
        assert not _moves_payload(QUERIES[name](spark, "/root/testdata/sf0.001"))
