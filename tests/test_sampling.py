"""Caps, strides and splits: rules pinned on small tables, invariants on larger ones."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from imgaudit.operators import lookups, sampling, serving


@pytest.fixture(scope="module")
def shards(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot"] * 4 + ["m1", "m2"]), None if i % 9 == 0 else f"p{i}")
            for i in range(1200)]
    return spark.createDataFrame(rows, "ord long, source string, payload string").cache()


def _by_source(df):
    out = {}
    for r in df.orderBy("ord").collect():
        out.setdefault(r.source, []).append(r)
    return out


def test_cap_counts_missing_payloads(shards):
    full = _by_source(shards)
    kept = _by_source(sampling.cap_per_key(shards, "source", "ord", {"m1": 20}, 50, "payload"))
    for source, rows in full.items():
        cap = 20 if source == "m1" else 50
        assert [r.ord for r in kept[source]] == [r.ord for r in rows[:cap] if r.payload]


def test_missing_payloads_do_not_use_up_first_n(shards):
    kept = sampling.take_first_nonnull(shards, 30, "ord", "payload").orderBy("ord").collect()
    full = [r.ord for r in shards.orderBy("ord").collect() if r.payload]
    assert [r.ord for r in kept] == full[:30]


def test_stride_counts_missing_payloads(shards):
    kept = _by_source(sampling.stride_sample(shards, {"m1": 3, "hot": 5}, "ord"))
    for source, rows in _by_source(shards).items():
        step = {"m1": 3, "hot": 5}.get(source, 1)
        assert [r.ord for r in kept[source]] == [r.ord for r in rows[::step]]


def test_tail_holdout_is_a_bounded_contiguous_tail(shards):
    split = _by_source(sampling.tail_holdout(shards, 60, "ord"))
    for rows in split.values():
        held = min(60, len(rows) // 5)
        assert [r.split for r in rows] == ["train"] * (len(rows) - held) + ["heldout"] * held


def test_tiny_source_has_no_holdout(spark):
    df = spark.createDataFrame([(i, "s") for i in range(4)], "ord long, source string")
    assert {r.split for r in sampling.tail_holdout(df, 10, "ord").collect()} == {"train"}


def test_curate_sources_in_one_pass(shards):
    caps = {"hot": (2, 100, 30), "m1": (1, 1000, 1000)}
    specs = {name: sampling.Spec(*cap) for name, cap in caps.items()}
    found = _by_source(sampling.curate_sources(shards, specs, "ord", "payload"))
    assert set(found) == set(specs)
    for source, (stride, train, held) in caps.items():
        rows = [r.ord for r in _by_source(shards)[source][::stride] if r.payload][:train + held]
        tail = min(held, len(rows) // 5)
        assert [r.ord for r in found[source]] == rows
        assert [r.split for r in found[source]].count("heldout") == tail


def test_head_holdout_is_disjoint_and_whole(shards):
    split = sampling.head_holdout(shards, 100, 3, "ord").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"heldout": 100, "train": 1100}


def test_seeded_take_repeats_and_differs_by_seed(shards):
    def take(seed, df=shards):
        return {r.ord for r in sampling.seeded_take(df, 80, seed, "ord").collect()}
    assert take(1) == take(1, shards.repartition(7)) != take(2)
    assert len(take(1)) == 80


def test_class_weights_sum_to_one_half(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "k int, label int")
    sums = sampling.class_weights(df).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 0.5) < 1e-9 for r in sums)


def test_balanced_resample(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "k int, label int")
    drawn = sampling.balanced_resample(df, "k", 4)
    assert drawn.count() == 2000
    share = drawn.agg(F.avg("label").alias("s")).first().s
    assert 0.45 < share < 0.55


def test_balanced_resample_of_one_class(spark):
    df = spark.createDataFrame([(i, 0) for i in range(50)], "k int, label int")
    assert sampling.balanced_resample(df, "k", 4).count() == 50


def test_augmentation_plan_bounds(spark):
    df = spark.range(3000).selectExpr("id AS k", "200 + id % 900 AS w", "150 + id % 700 AS h")
    plan = sampling.augmentation_plan(df, "k", 1)
    share = plan.select(F.avg((F.col("regime") == "thumb").cast("int")).alias("thumb"),
                        F.avg(F.col("format1").isNotNull().cast("int")).alias("first"),
                        F.avg(F.col("flip").cast("int")).alias("flip"),
                        F.min("x0").alias("x0"), F.min("quality1").alias("q0"),
                        F.max("quality1").alias("q1"),
                        F.max(F.col("x0") + 384 - F.col("resized_w")).alias("over")).first()
    assert abs(share.thumb - 0.25) < 0.04 and abs(share["first"] - 0.85) < 0.04
    assert abs(share.flip - 0.5) < 0.04 and share.x0 >= 0 and share.over <= 0
    assert 30 <= share.q0 and share.q1 <= 95


def test_unknown_prefix_fails(spark):
    df = spark.createDataFrame([("x/niji_1.png",), ("x/zzz_2.png",)], "path string")
    known = lookups.apply_taxonomy(df.filter("path LIKE '%niji%'")).first()
    assert (known.label, known.source) == (1, "ai_niji")
    with pytest.raises(Exception, match="unknown source prefix: zzz"):
        lookups.apply_taxonomy(df).collect()


def test_cache_lookup_prefers_exact_then_oldest_base(spark):
    cache = spark.createDataFrame([("a?x=2", 0.2, 5), ("a?x=1", 0.1, 3), ("b", 0.9, 1)],
                                  "url string, score double, seq long")
    asked = spark.createDataFrame([(1, "a?x=2"), (2, "a?x=9"), (3, "b?y"), (4, "c")],
                                  "req int, url string")
    found = {r.req: (r.score, r.matched) for r in lookups.cache_lookup(asked, cache).collect()}
    assert found == {1: (0.2, "exact"), 2: (0.1, "base"), 3: (0.9, "base"), 4: (None, None)}


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_cache_lookup_reads_requests_once(spark, tmp_path):
    """Hot, null and unknown urls get their rows, and no side is read more than twice."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot?a"] * 5 + [None] * 2 + ["missing"] * 2 + [f"k{i % 1500}?b"]))
            for i in range(6000)]
    entries = [("hot?a", 0.5, 0)] + [(f"k{i}?c", i / 1000, i + 1) for i in range(0, 1500, 2)]
    spark.createDataFrame(rows, "req int, url string").write.parquet(f"{tmp_path}/asked")
    spark.createDataFrame(entries, "url string, score double, seq long").write.parquet(f"{tmp_path}/cache")
    asked, cache = spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/cache")
    found = lookups.cache_lookup(asked, cache)
    assert _scans(found) <= 3
    exact = {u: s for u, s, _ in entries}
    base = {u.split("?")[0]: s for u, s, _ in entries}
    expected = [(i, u, exact.get(u, base.get((u or "").split("?")[0]) if u else None)) for i, u in rows]
    assert sorted(map(tuple, found.select("req", "url", "score").collect())) == expected


def test_payload_moves_only_in_the_last_join(spark, tmp_path):
    """Choices are made on narrow columns: no exchange below the final join holds the payload."""
    df = spark.range(500).selectExpr("id AS k", "id % 2 AS label", "'s' AS source", "repeat('x', 50) AS payload")
    df.write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    for out in (sampling.balanced_resample(wide, "k", 1), sampling.stride_sample(wide, 7, "k")):
        windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n")
                   if "Window" in line]
        assert windows and not any("payload" in line for line in windows)
        assert out.count() > 0


def test_pair_rows_without_a_side_take_no_position(spark):
    rows = [(i, "pairs" if i < 30 else "plain", "x" if i % 2 else None, "img") for i in range(60)]
    df = spark.createDataFrame(rows, "o int, source string, model string, image string")
    specs = {"pairs": sampling.Spec(3, 100, 0, pair="x"),
             "plain": sampling.Spec(3, 100, 0, where=F.col("o") >= 40)}
    found = sampling.curate_sources(df.withColumn("image", F.when(F.col("o") % 4 != 0, F.col("image"))),
                                    specs, "o", "image", sides=[("image", "model")])
    kept = sorted((r.source, r.o) for r in found.collect())
    sided = [i for i in range(30) if i % 2]
    plain = [i for i in list(range(40, 60))[::3] if i % 4]
    assert kept == [("pairs", i) for i in sided[::3]] + [("plain", i) for i in plain]
    assert [r.o for r in sampling.stride_sample(df, 2, "o", needs="model").filter(
        "source = 'pairs'").orderBy("o").collect()] == sided[::2]


def test_valid_cache(spark):
    cache = spark.createDataFrame([("a", "old"), ("b", "cur"), ("c", None), ("d", "")],
                                  "url string, model_version string")

    def kept(version):
        return {r.url for r in lookups.valid_cache(cache, version).collect()}
    assert (kept("cur"), kept(None)) == ({"b"}, {"a", "b"})


def test_stale_models(spark):
    clients = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "client string")
    installed = spark.createDataFrame([("a", "old"), ("b", "cur"), ("d", None)],
                                      "client string, version string")

    def outdated(pinned):
        return {r.client for r in lookups.stale_models(clients, installed, pinned).collect()
                if r.outdated}
    assert (outdated("cur"), outdated(""), outdated(None)) == ({"a", "d"}, set(), set())


def test_retry_plan_follows_one_image_through_ranges(spark):
    rng = random.Random(2)
    errors = [rng.choice([None, "fetch 503", "fetch 503", "too-small"]) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(errors)), "o long, error string").withColumn(
        "image", F.lit("hot"))
    count = 0
    plan = serving.retry_plan(df, ["image"], "o").orderBy("o").collect()
    for r, error in zip(plan, errors):
        if error is None:
            count, expected = 0, ("ok", None)
        elif error == "too-small":
            expected = ("never", None)
        else:
            count += 1
            expected = ("retry", 3000 * count) if count <= 3 else ("give-up", None)
        assert (r.failures, r.decision, r.delay_ms) == (count, *expected)


def test_cover_join(spark):
    rng = random.Random(5)

    def some(n, side):
        out = []
        for i in range(n):
            x, y = rng.randrange(-50, 300), rng.randrange(300)
            out.append((i, rng.choice(["p", "p", "p", "q", None]), x, y, x + rng.randrange(side), y + rng.randrange(side)))
        return out

    images, boxes = some(150, 60), some(300, 200)
    schema = "{} int, page string, x0 int, y0 int, x1 int, y1 int"
    found = lookups.cover_join(spark.createDataFrame(images, schema.format("image")),
                               spark.createDataFrame(boxes, schema.format("box_id")), "page").collect()

    def covers(a, b):
        wide = max(0, min(a[4], b[4]) - max(a[2], b[2]))
        high = max(0, min(a[5], b[5]) - max(a[3], b[3]))
        sized = all(r[4] - r[2] >= 1 and r[5] - r[3] >= 1 for r in (a, b))
        return sized and wide * high >= (a[4] - a[2]) * (a[5] - a[3]) * 0.8

    want = [(a[0], b[0]) for a in images for b in boxes if a[1] and a[1] == b[1] and covers(a, b)]
    assert sorted((r.image, r.box_id) for r in found) == sorted(want) and len(want) > 100
    with pytest.raises(ValueError):
        lookups.cover_join(spark.createDataFrame(images, schema.format("image")),
                           spark.createDataFrame(boxes, schema.format("box_id")), "page", 0.4)


def test_cover_join_of_very_different_sizes(spark):
    """Boxes of 8 to 100,000 pixels: at most four rows per box, and no pair is lost."""
    rng = random.Random(6)

    def some(n, sides):
        out = []
        for i in range(n):
            w, h = rng.choice(sides), rng.choice(sides)
            x, y = rng.choice([-w, 0, 64, rng.uniform(-500, 500)]), rng.choice([0.0, -8, rng.uniform(-500, 500)])
            out.append((i, rng.choice(["p", "q", "r"]), float(x), float(y), float(x + w), float(y + h)))
        return out

    sides = [1, 1.5, 8, 9, 16, 64, 100, 1000, 1024, 20_000, 100_000, 65_536.5]
    images, boxes = some(300, sides[:9]), some(600, sides) + [(900, "p", 0.0, 0.0, 0.5, 9.0)]
    odd = [(901, "p", 0.0, 0.0, float("inf"), 5.0), (902, "p", float("nan"), 0.0, 9.0, 9.0), (903, None, 0.0, 0.0, 9.0, 9.0)]
    schema = "{} int, page string, x0 double, y0 double, x1 double, y1 double"
    frame = spark.createDataFrame(boxes + odd, schema.format("box_id"))
    cells = lookups.box_cells(frame, "page")
    assert cells.groupBy("box_id").count().agg({"count": "max"}).first()[0] <= 4
    for share in (0.6, 0.8, 1.0):
        found = lookups.cover_join(spark.createDataFrame(images + odd[:2], schema.format("image")), frame, "page", share)

        def covers(a, b):
            wide = max(0, min(a[4], b[4]) - max(a[2], b[2]))
            high = max(0, min(a[5], b[5]) - max(a[3], b[3]))
            return b[4] - b[2] >= 1 and wide * high >= (a[4] - a[2]) * (a[5] - a[3]) * share

        want = [(a[0], b[0]) for a in images for b in boxes if a[1] == b[1] and covers(a, b)]
        assert sorted((r.image, r.box_id) for r in found.collect()) == sorted(want) and len(want) > 500


def test_cover_join_with_one_page_sized_box(spark):
    """One box of 100,000 pixels among small ones makes four rows, not one per small cell."""
    small = [(i, "p", i % 50 * 8, i // 50 * 8, i % 50 * 8 + 8, i // 50 * 8 + 8) for i in range(2000)]
    schema = "{} int, page string, x0 int, y0 int, x1 int, y1 int"
    frame = spark.createDataFrame(small + [(9999, "p", 0, 0, 100_000, 100_000)], schema.format("box_id"))
    assert lookups.box_cells(frame, "page").filter("box_id = 9999").count() <= 4
    assert lookups.box_cells(frame, "page").count() <= 4 * 2001
    images = spark.createDataFrame(small[:100], schema.format("image"))
    found = lookups.cover_join(images, frame, "page").collect()
    assert sorted((r.image, r.box_id) for r in found) == sorted(
        [(i, i) for i in range(100)] + [(i, 9999) for i in range(100)])


def test_cover_join_of_empty_tables(spark):
    schema = "{} int, page string, x0 int, y0 int, x1 int, y1 int"
    images, boxes = (spark.createDataFrame([], schema.format(c)) for c in ("image", "box_id"))
    assert lookups.cover_join(images, boxes, "page").count() == 0


@pytest.mark.parametrize("most", [65_536, 40])
def test_cover_join_of_equal_boxes_in_crowded_cells(spark, monkeypatch, most):
    """Equal boxes and images, also without an id, lose and double no pair when cells are dealt to parts."""
    monkeypatch.setattr(lookups, "CROWDED", most)
    monkeypatch.setattr(lookups, "BLOCK", 16)
    sides = [(0.0, 0.0, 100.0, 100.0), (-0.0, 0.0, 100.0, 100.0), (50.0, 60.0, 120.0, 130.0), (-9.0, -9.0, 900.0, 900.0)]
    images = [(None if i % 50 == 0 else i, "p", *sides[i % 3]) for i in range(200)]
    boxes = [(None if i % 70 == 0 else i, "p" if i % 9 else None, *sides[i % 4]) for i in range(300)]
    schema = "{} int, page string, x0 double, y0 double, x1 double, y1 double"
    found = lookups.cover_join(spark.createDataFrame(images, schema.format("image")),
                               spark.createDataFrame(boxes, schema.format("box_id")), "page").collect()

    def covers(a, b):
        wide, high = (max(0, min(a[c + 2], b[c + 2]) - max(a[c], b[c])) for c in (2, 3))
        return wide * high >= (a[4] - a[2]) * (a[5] - a[3]) * 0.8

    want = [(a[0], b[0]) for a in images for b in boxes if a[1] == b[1] and covers(a, b)]
    assert Counter((r.image, r.box_id) for r in found) == Counter(want) and len(want) > 20_000


def test_cover_join_writes_pairs_of_equal_boxes_in_few_bytes(spark, tmp_path):
    images = spark.range(1500).selectExpr("id AS image", "id % 3 AS page", "id * 37 % 50 AS x0", "id * 53 % 50 AS y0",
                                          "id * 37 % 50 + 20 AS x1", "id * 53 % 50 + 20 AS y1")
    boxes = spark.range(12_000).selectExpr("id AS box_id", "id % 3 AS page", "id % 20 AS x0", "id % 10 AS y0",
                                           "id % 20 + 60 AS x1", "id % 10 + 60 AS y1")
    out = str(tmp_path / "pairs")
    lookups.cover_join(images, boxes, "page").select("image", "box_id").write.parquet(out)
    pairs = spark.read.parquet(out).count()
    assert pairs > 3_000_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < pairs * 0.5


def test_cover_join_spells_pairs_out_apart_from_the_join(spark):
    """Compiled into one loop, all pairs of a block with the images of its cell would be held before the first is returned."""
    images, boxes = (spark.range(50).selectExpr(f"id AS {name}", "id % 2 AS page", "0 AS x0", "0 AS y0", "9 AS x1", "9 AS y1")
                     for name in ("image", "box_id"))
    found = lookups.cover_join(images, boxes, "page")
    assert len(found.collect()) == 2 * 25 * 25
    plan = found._jdf.queryExecution().executedPlan().toString()
    spelled = re.findall(r"\*\((\d+)\) Generate explode\(_ids", plan)
    joined = re.findall(r"\*\((\d+)\) SortMergeJoin \[page[^]]*_ipart", plan)
    assert spelled and joined and not set(spelled) & set(joined)
