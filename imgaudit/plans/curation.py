"""Shard planning, caps, splits, balancing, plans and written manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.functions import labels
from imgaudit.operators import metrics, sampling, shards
from imgaudit.plans import views
from imgaudit.plans.registry import Tables, query
from imgaudit.plans.views import draw_sql, int_sql, sql, unit_sql
from imgaudit.session import shared_dir
from imgaudit.sources import manifests, sinks

_CAPS = {"org_src0": 20, "org_src1": 30}
_GEN = "replace(coalesce(nullif(model, ''), 'unknown'), '/', '_')"
_CAP = "CASE gen WHEN 'org_src0' THEN 20 WHEN 'org_src1' THEN 30 ELSE 10 END"


def _files(t: Tables) -> DataFrame:
    return views.shards(t).select("file").distinct()


_LISTING = """files AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS pos,
    count(*) OVER () AS n FROM (SELECT DISTINCT file FROM shards))"""


@query(sql("shards", f"""
    {_LISTING} SELECT file FROM files WHERE pos IN (
        SELECT CAST(floor(i * (64/24e0)) AS BIGINT) FROM range(24) AS r(i))"""))
def even_sample(t: Tables) -> DataFrame:
    return shards.even_sample(_files(t), 24)


@query(sql("shards", f"{_LISTING} SELECT file, pos % least(13, n) AS gid FROM files"))
def round_robin_groups(t: Tables) -> DataFrame:
    return shards.round_robin_groups(_files(t), 13)


@query(sql("shards", f"""
    named AS (SELECT *, {_GEN} AS gen FROM shards WHERE label = 'fake')
    SELECT ord, gen AS generator FROM (SELECT *, row_number() OVER (PARTITION BY gen ORDER BY ord) AS rn
        FROM named) WHERE rn <= {_CAP} AND payload IS NOT NULL"""))
def cap_per_key(t: Tables) -> DataFrame:
    fakes = views.shards(t).filter("label = 'fake'").withColumn(
        "generator", labels.generator("model"))
    return sampling.cap_per_key(fakes, "generator", "ord", _CAPS, 10, "payload").select(
        "ord", "generator")


@query(sql("shards", """
    SELECT ord, file FROM (SELECT * FROM shards WHERE label = 'real' ORDER BY ord LIMIT 150)
    WHERE payload IS NOT NULL"""))
def cap_class(t: Tables) -> DataFrame:
    return sampling.cap_class(views.shards(t), 150, "ord", "label", "real", "payload").select(
        "ord", "file")


_CORPUS = f"""
    named AS (SELECT *, {_GEN} AS gen FROM shards),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN label = 'fake' THEN gen END,
        label ORDER BY ord) AS rn FROM named),
    corpus AS (SELECT ord, CASE WHEN label = 'fake' THEN 1 ELSE 0 END AS label,
        concat(CASE WHEN label = 'fake' THEN 'of_' ELSE 'of_real_' END, gen) AS source, file
        FROM ranked WHERE rn <= CASE WHEN label = 'fake' THEN {_CAP} ELSE 150 END
        AND payload IS NOT NULL)"""


def _corpus(t: Tables) -> DataFrame:
    return sampling.capped_corpus(views.shards(t), "ord", _CAPS, 150, "train", "payload", 10)


@query(sql("shards", f"{_CORPUS} SELECT ord, label, source FROM corpus"))
def capped_corpus(t: Tables) -> DataFrame:
    return _corpus(t).select("ord", "label", "source")


@query(sql("shards", f"""
    {_CORPUS}, groups AS (SELECT file, (row_number() OVER (ORDER BY file) - 1) % 13 AS gid
        FROM (SELECT DISTINCT file FROM shards))
    SELECT gid, count(*) AS kept,
        count(DISTINCT CASE WHEN label = 1 THEN source END) AS fake_models,
        count(*) FILTER (label <> 1) AS real
    FROM corpus JOIN groups USING (file) GROUP BY gid"""))
def group_report(t: Tables) -> DataFrame:
    gids = shards.round_robin_groups(_files(t), 13)
    return shards.group_report(_corpus(t).join(gids, "file"))


@query(sql("shards", """
    SELECT ord, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn
        FROM (SELECT ord, coalesce(model, 'none') AS source FROM shards))
    WHERE (rn - 1) % 7 = 0"""))
def stride_sample(t: Tables) -> DataFrame:
    named = views.shard_rows(t).select("ord", F.coalesce("model", F.lit("none")).alias("source"), *views.ADDRESS)
    return sampling.stride_sample(named, 7, "ord", address=views.ADDRESS).select("ord", "source")


@query(sql("scores", """
    SELECT path, label FROM scores WHERE view = 'clean'
    ORDER BY md5(concat('0:', path)), path LIMIT 100"""))
def seeded_take(t: Tables) -> DataFrame:
    return sampling.seeded_take(views.clean_scores(t), 100, 0, "path").select("path", "label")


@query("""
    SELECT doc_id, source, CASE WHEN rn <= least(12, n // 5) THEN 'heldout' ELSE 'train' END AS split
    FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn,
        count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def tail_holdout(t: Tables) -> DataFrame:
    return sampling.tail_holdout(t.documents.select("doc_id", "source"), 12, "doc_id")


@query(sql("shards", """
    usable AS (SELECT *, max(file) OVER () AS last FROM shards WHERE payload IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file = last ORDER BY ord) AS rn FROM usable)
    SELECT ord, file, CASE WHEN file = last THEN 'heldout' ELSE 'train' END AS split
    FROM ranked WHERE rn <= CASE WHEN file = last THEN 10 ELSE 200 END"""))
def shard_disjoint_split(t: Tables) -> DataFrame:
    return sampling.shard_disjoint_split(views.shards(t), "file", "ord", 200, 10, "payload").select(
        "ord", "file", "split")


@query(sql("scores", """
    SELECT path, CASE WHEN rn <= 60 THEN 'heldout' ELSE 'train' END AS split
    FROM (SELECT path, row_number() OVER (ORDER BY md5(concat('5:', path)), path) AS rn
        FROM scores WHERE view = 'clean')"""))
def head_holdout(t: Tables) -> DataFrame:
    return sampling.head_holdout(views.clean_scores(t), 60, 5, "path").select("path", "split")


@query(sql("scores", """
    clean AS (SELECT path FROM scores WHERE view = 'clean')
    SELECT 'larger' AS kind, path FROM (SELECT path FROM clean
        ORDER BY md5(concat('0:', path)), path LIMIT 150)
    UNION ALL SELECT 'smaller', path FROM clean"""))
def subsample_if_larger(t: Tables) -> DataFrame:
    clean = views.clean_scores(t).select("path")
    parts = [sampling.subsample_if_larger(clean, cap, 0, "path").select(
        F.lit(kind).alias("kind"), "path") for kind, cap in (("larger", 150), ("smaller", 100000))]
    return parts[0].unionByName(parts[1])


@query(sql("scores", """
    SELECT path, 0.5e0/greatest(count(*) OVER (PARTITION BY label = 1), 1) AS weight
    FROM scores WHERE view = 'clean'"""))
def class_weights(t: Tables) -> DataFrame:
    return sampling.class_weights(views.clean_scores(t)).select("path", "weight")


@query(sql("scores", f"""
    clean AS (SELECT path, label, row_number() OVER (PARTITION BY label = 1 ORDER BY path) - 1 AS pos,
        CASE WHEN label = 1 THEN 1 ELSE 0 END AS cls FROM scores WHERE view = 'clean'),
    sizes AS (SELECT cls, count(*) AS n FROM clean GROUP BY cls),
    wanted AS (SELECT path AS draw_key, {draw_sql("path", "3:class")} % 2 AS cls FROM clean),
    draws AS (SELECT draw_key, cls, {draw_sql("draw_key", "3:row")} % n AS pos
        FROM wanted JOIN sizes USING (cls))
    SELECT draw_key, path, label FROM draws JOIN clean USING (cls, pos)"""))
def balanced_resample(t: Tables) -> DataFrame:
    return sampling.balanced_resample(views.clean_scores(t).select("path", "label"), "path", 3)


@query("""
    SELECT doc_id, source FROM (SELECT doc_id, source,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
    WHERE rn <= CASE source WHEN 'src3' THEN 22 WHEN 'src4' THEN 11 ELSE 0 END""")
def total_cap(t: Tables) -> DataFrame:
    return sampling.total_cap(t.documents.select("doc_id", "source"), {"src3": 22, "src4": 11},
                              "doc_id")


@query(sql("shards", "SELECT ord FROM shards WHERE payload IS NOT NULL ORDER BY ord LIMIT 120"))
def take_first_nonnull(t: Tables) -> DataFrame:
    return sampling.take_first_nonnull(views.shards(t), 120, "ord", "payload").select("ord")


_CAPTION = "th|en"


@query(sql("shards", f"""
    specs AS (SELECT * FROM (VALUES ('org/src2', 1, 30, 6), ('org/src5', 2, 20, 9),
        ('org/src8', 3, 100, 50), ('org/src11', 2, 40, 5)) AS s(source, stride, train, heldout)),
    picked AS (SELECT s.*, ord, model1, CASE WHEN source <> 'org/src11' THEN payload
        WHEN contains(lower(coalesce(model1, '')), 'recraft') THEN payload
        WHEN contains(lower(coalesce(model2, '')), 'recraft') THEN file END AS image
        FROM shards JOIN specs s ON model = source
        WHERE CASE source WHEN 'org/src5' THEN regexp_matches(coalesce(payload, ''), '(?i){_CAPTION}')
            WHEN 'org/src8' THEN regexp_matches(file, '000[0-3]') ELSE true END),
    strided AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn
            FROM picked WHERE source <> 'org/src11' OR image IS NOT NULL)
        WHERE (rn - 1) % stride = 0 AND image IS NOT NULL),
    capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS kept
        FROM strided) WHERE kept <= train + heldout),
    tailed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord DESC) AS back,
        count(*) OVER (PARTITION BY source) AS n FROM capped)
    SELECT ord, source, md5(image) AS image,
        CASE WHEN back <= least(heldout, n // 5) THEN 'heldout' ELSE 'train' END AS split
    FROM tailed"""))
def curate_sources(t: Tables) -> DataFrame:
    """Sources of all kinds: plain, by caption, by date (here the file's number), and pairs."""
    named = views.shard_rows(t).withColumn("source", F.col("model")).withColumn("image", F.col("payload"))
    specs = {"org/src2": sampling.Spec(1, 30, 6),
             "org/src5": sampling.Spec(2, 20, 9, where=labels.text_match("payload", _CAPTION)),
             "org/src8": sampling.Spec(3, 100, 50, where=F.col("file").rlike("000[0-3]")),
             "org/src11": sampling.Spec(2, 40, 5, pair="recraft")}
    curated = sampling.curate_sources(named, specs, "ord", "image",
                                      sides=[("payload", "model1"), ("file", "model2")],
                                      address=views.ADDRESS)
    return curated.select("ord", "source", F.md5("image").alias("image"), "split")


@query(sql("scores", """
    SELECT path, view, z FROM scores WHERE doc_id % 97 <> 0"""))
def drop_failures(t: Tables) -> DataFrame:
    z = F.when(F.col("doc_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("z"))
    return sampling.drop_failures(views.scores(t).withColumn("z", z)).select("path", "view", "z")


@query(sql("scores", f"""
    picked AS (SELECT * FROM scores WHERE view = 'clean' AND label = 1
        AND (starts_with(source, 'src1') OR starts_with(source, 'src4'))
        ORDER BY md5(concat('5:', path)), path LIMIT 75),
    drawn AS (SELECT *, row_number() OVER (ORDER BY md5(concat('5:', path)), path) AS rn,
        {int_sql("path", "5:side", "180", "320")} AS target,
        {int_sql("path", "5:quality", "45", "80")} AS quality FROM picked)
    SELECT path, concat(source, '_small') AS source, 1 AS label, target, quality,
        CASE WHEN rn <= 15 THEN 'heldout' ELSE 'train' END AS split,
        CASE WHEN least(w, h) > target THEN greatest(64, CAST(round_even(
            w * (target/CAST(least(w, h) AS DOUBLE)), 0) AS BIGINT)) ELSE w END AS out_w,
        CASE WHEN least(w, h) > target THEN greatest(64, CAST(round_even(
            h * (target/CAST(least(w, h) AS DOUBLE)), 0) AS BIGINT)) ELSE h END AS out_h
    FROM drawn"""))
def small_copies_plan(t: Tables) -> DataFrame:
    fakes = views.clean_scores(t).filter("label = 1")
    return sampling.small_copies_plan(fakes, "path", 5, 60, 15, ("src1", "src4")).select(
        "path", "source", "label", "target", "quality", "split", "out_w", "out_h")


def _plan_sql() -> str:
    def unit(name):
        return unit_sql("path", f"2:{name}")

    def whole(name, low, high):
        return int_sql("path", f"2:{name}", low, high)

    scaled = ", ".join(f"CASE WHEN factor IS NULL THEN {s} ELSE greatest(64, CAST(round_even("
                       f"{s} * factor, 0) AS BIGINT)) END AS scaled_{s}" for s in "wh")
    resized = ", ".join(f"greatest(384, CAST(round_even(scaled_{s} * (440/CAST(least(scaled_w, "
                        f"scaled_h) AS DOUBLE)), 0) AS BIGINT)) AS resized_{s}" for s in "wh")
    encodings = ", ".join(
        f"CASE WHEN {unit(f'encode{i}')} < {p}e0 THEN CASE WHEN {unit(f'webp{i}')} < 0.25e0 THEN "
        f"'webp' ELSE 'jpeg' END END AS format{i}, CASE WHEN {unit(f'encode{i}')} < {p}e0 THEN "
        f"{whole(f'quality{i}', '30', '95')} END AS quality{i}" for i, p in ((1, 0.85), (2, 0.3)))
    return f"""
    regimes AS (SELECT path, w, h, CASE WHEN {unit("thumb")} < 0.25e0 THEN 'thumb'
        WHEN {unit("rescale")} < 0.7e0 THEN 'rescale' ELSE 'none' END AS regime,
        {whole("target", "180", "320")} AS target FROM scores WHERE view = 'clean'),
    factors AS (SELECT *, CASE WHEN regime = 'rescale' THEN 0.4e0 + {unit("factor")} * 0.9e0
        WHEN regime = 'thumb' AND least(w, h) > target THEN target/CAST(least(w, h) AS DOUBLE) END
        AS factor FROM regimes),
    scaled AS (SELECT *, {scaled} FROM factors),
    resized AS (SELECT *, {resized} FROM scaled)
    SELECT path, regime, round(factor, 9) AS factor, scaled_w, scaled_h,
        CASE WHEN factor IS NOT NULL THEN ['nearest', 'bilinear', 'bicubic', 'lanczos'][
            {whole("filter", "0", "3")} + 1] END AS filter,
        {encodings}, resized_w, resized_h, {whole("x", "0", "(resized_w - 384)")} AS x0,
        {whole("y", "0", "(resized_h - 384)")} AS y0, {unit("flip")} < 0.5e0 AS flip
    FROM resized"""


@query(sql("scores", _plan_sql()))
def augmentation_plan(t: Tables) -> DataFrame:
    plan = sampling.augmentation_plan(views.clean_scores(t).select("path", "w", "h"), "path", 2)
    return plan.drop("w", "h").withColumn("factor", F.round("factor", 9))


# ------------------------------------------------------------------ written tables

def _manifest(t: Tables) -> DataFrame:
    return views.clean_scores(t).select("path", F.col("label").cast("int"), "source", "subset")


@query(sql("scores", """
    SELECT path, label, source, subset FROM scores WHERE view = 'clean'"""))
def manifest_csv(t: Tables) -> DataFrame:
    """Written as CSV with a header and loaded again; a missing manifest is skipped."""
    root = shared_dir(t.spark, "manifest")
    manifests.write_manifest(_manifest(t), f"{root}/train")
    return manifests.load_manifests(t.spark, [f"{root}/train", f"{root}/absent"], "skip")


@query(sql("scores", """
    SELECT path, subset, CASE WHEN label = 1 THEN 'fake' ELSE 'real' END AS cls
    FROM scores WHERE view = 'clean'"""))
def materialize(t: Tables) -> DataFrame:
    root = f"{shared_dir(t.spark, 'corpus')}/images"
    content = F.encode("path", "utf-8").alias("content")
    sinks.run_stage(t.spark, f"{root}-picked", lambda: _manifest(t).select("*", content))
    sinks.materialize(t.spark.read.parquet(f"{root}-picked"), root)
    return t.spark.read.parquet(root).select("path", "subset", "cls")


@query(sql("shards", f"{_CORPUS} SELECT ord, label, source FROM corpus"))
def merge_partials(t: Tables) -> DataFrame:
    """Two shard groups written one after the other into one manifest folder."""
    root = f"{shared_dir(t.spark, 'partials')}/manifest"
    corpus = _corpus(t).select("ord", "label", "source", (F.col("ord") % 2).alias("gid"))
    for gid in (0, 1):
        sinks.write_partial(corpus.filter(F.col("gid") == gid), root)
    return sinks.merge_partials(t.spark, root).select("ord", "label", "source")


@query(sql("scores", "SELECT path, label, source, view, z, 'm1' AS model_tag FROM scores"))
def write_logits(t: Tables) -> DataFrame:
    root = f"{shared_dir(t.spark, 'logits')}/logits"
    sinks.write_logits(views.scores(t).select(
        "path", "label", "source", "view", "z", F.lit("m1").alias("model_tag")), root)
    return t.spark.read.parquet(root).select("path", "label", "source", "view", "z", "model_tag")


@query(sql("scores", """
    SELECT subset, count(*) FILTER (label = 1) AS fake, count(*) FILTER (label <> 1) AS real
    FROM scores WHERE view = 'clean' GROUP BY subset"""))
def manifest_counts(t: Tables) -> DataFrame:
    return metrics.manifest_counts(_manifest(t))


@query(sql("scores", """
    SELECT source, count(*) AS n FROM scores WHERE view = 'clean' AND label = 1
    GROUP BY source ORDER BY n DESC, source LIMIT 15"""))
def top_sources(t: Tables) -> DataFrame:
    return metrics.top_sources(_manifest(t))
