"""Decoded images: degenerate fills, tensors, folder scans."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import __spark_entry__ as driver
from image_files import png
from imgaudit import fixed_values as fixed
from imgaudit import session
from imgaudit.operators import degenerate, forensics, scoring
from imgaudit.sources import manifests, sinks


def test_folders_are_listed_by_tasks(spark, folder):
    """Two folders already make a Spark job, and the session's setting is as it was."""
    name = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before, tracker = spark.conf.get(name), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    found = manifests.scan_image_dir(spark, folder, "sb_", content=False)
    assert tracker.getJobIdsForGroup("listing") and spark.conf.get(name) == before
    spark.sparkContext.setJobGroup("other", "other")
    assert sorted(r.source for r in found.collect()) == ["sb_gen_a", "sb_gen_a", "sb_gen_b"]


def test_listed_files_share_tasks(spark, tmp_path):
    """Files that are not read do not make a task for every few of them."""
    count = 10 * manifests.LISTING_TASKS * spark.sparkContext.defaultParallelism // 8
    (tmp_path / "gen_a").mkdir()
    for i in range(count):
        (tmp_path / "gen_a" / f"{i}.png").write_bytes(b"x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        found = manifests.scan_image_dir(spark, str(tmp_path), content=False)
        assert found.rdd.getNumPartitions() <= manifests.LISTING_TASKS * spark.sparkContext.defaultParallelism < count
        assert found.count() == count
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_listed_files_are_not_held_by_the_driver(spark, tmp_path):
    """The driver knows the parts of the written list, not the files."""
    for name in ("gen_a", "gen_b"):
        (tmp_path / name).mkdir()
        for i in range(200):
            (tmp_path / name / f"{i}.png").write_bytes(b"x")
    found = manifests.scan_image_dir(spark, str(tmp_path), content=False)
    assert found.count() == 400 and len(found.inputFiles()) < 100


@pytest.mark.parametrize("rows", [10_000, 3])
def test_listed_files_are_those_that_are_read(spark, tmp_path, monkeypatch, rows):
    """Paths, lengths and times are those of Spark's own reader, for odd names, links and patterns too."""
    monkeypatch.setattr(manifests, "LISTING_ROWS", rows)
    names = ["top.png", "a/b.png", "a/c d%20.png", "a/[e].PNG", "a/b/\u00e4.jpg", "a/.h.png", "a/_h.png", "a/_k=1.png", "a/x=1/y.png",
             ".git/a.png", "_tmp/a.png", "_q=1/a.png", "_metadata_1/a.png", "a/_metadata_1.png", "a/z.png._COPYING_", "a/n.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "a" / "empty.png").write_bytes(b"")
    (tmp_path / "none").mkdir()
    os.symlink(tmp_path / "a" / "b.png", tmp_path / "none" / "link.png")
    os.symlink(tmp_path / "gone.png", tmp_path / "none" / "broken.png")
    os.symlink(tmp_path / "a" / "x=1", tmp_path / "linked")
    with open(os.fsencode(tmp_path) + b"/a/\xff.png", "wb") as out:
        out.write(b"x")
    endings = (".png", ".jpg", "_")
    for root in (tmp_path, f"file://{tmp_path}/", tmp_path / "a", tmp_path / "a" / "b.png", tmp_path / "none", f"{tmp_path}/*", f"{tmp_path}/{{a,top}}*",
                 tmp_path / ".git"):
        listed, read = (manifests.scan_image_dir(spark, str(root), "sb_", endings, content).drop("content") for content in (False, True))
        assert listed.dtypes == read.dtypes
        assert sorted(listed.collect()) == sorted(read.collect()), root
    assert manifests.scan_image_dir(spark, str(tmp_path), content=False).count() >= 8
    (tmp_path / "nothing").mkdir()
    assert manifests.scan_image_dir(spark, str(tmp_path / "nothing"), content=False).count() == 0
    for content in (False, True):
        with pytest.raises(AnalysisException):
            manifests.scan_image_dir(spark, str(tmp_path / "absent"), content=content)


def test_written_files_cross_no_exchange(spark, monkeypatch):
    """The folder scan's query writes whole texts from where they are read."""
    plans, write = [], sinks.write_files

    def seen(files, *more):
        plans.append(files._jdf.queryExecution().executedPlan().toString())
        return write(files, *more)
    monkeypatch.setattr(sinks, "write_files", seen)
    driver.queries()["scan_image_dir"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "Exchange" not in plans[0]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    rng = random.Random(4)
    files = {
        "gen_a/black.png": png(64, 64),
        "gen_a/noise.PNG": png(64, 64, lambda x, y: [rng.randrange(256) for _ in range(3)]),
        "gen_b/ramp.png": png(90, 70, lambda x, y: (2 * x, 3 * y, x + y)),
        "gen_b/.hidden.png": png(),
        "gen_b/notes.txt": b"no image",
    }
    for name, content in files.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_scan_image_dir(spark, folder):
    rows = manifests.scan_image_dir(spark, folder, "sb_").collect()
    assert {(os.path.basename(r.path), r.source) for r in rows} == {
        ("black.png", "sb_gen_a"), ("noise.PNG", "sb_gen_a"), ("ramp.png", "sb_gen_b")}


def test_degenerate_images(spark, folder):
    images = manifests.read_images(spark, folder)
    rows = degenerate.image_stats(images).select(
        "path", degenerate.degenerate_reason().alias("reason")).collect()
    assert {os.path.basename(r.path): r.reason for r in rows if "hidden" not in r.path} == {
        "black.png": "flat", "noise.PNG": "noise", "ramp.png": None}


def test_row_step_is_the_callers(spark):
    """Rows between the steps count unless the caller leaves them out."""
    rows = np.zeros((6, 4, 1), np.uint8)
    rows[1::2] = 200
    df = spark.createDataFrame([("p", 6, 4, 1, bytearray(rows.tobytes()))],
                               "path string, height int, width int, channels int, data binary")
    assert degenerate.image_stats(df).first().variance == 10_000
    assert degenerate.image_stats(df, lambda height: height // 3).first().variance == 0


def _one_value(pixels, size, axis, at):
    """Triangle-filtered value at one output position, straight from the definition."""
    source = pixels.shape[axis]
    scale = source / size
    width = max(scale, 1.0)
    total, weight = 0.0, 0.0
    for k in range(source):
        w = max(0.0, 1 - abs((k + 0.5 - (at + 0.5) * scale) / width))
        total = total + w * np.take(pixels, k, axis)
        weight += w
    return total / weight


@pytest.mark.parametrize("shorter,crop", [(35, 24), (140, 100)])
def test_prepare_tensors(spark, folder, shorter, crop):
    images = manifests.read_images(spark, folder).filter(F.col("path").contains("ramp"))
    row = scoring.prepare_tensors(images, shorter, crop).first()
    tensor = np.asarray(row.tensor).reshape(3, crop, crop)
    x, y = np.meshgrid(np.arange(90), np.arange(70))
    pixels = np.stack([2 * x, 3 * y, x + y], axis=-1).astype(float)
    scale = shorter / 70
    rows, cols = (max(crop, int(np.floor(s * scale + 0.5))) for s in (70, 90))
    y0, x0 = (rows - crop) // 2, (cols - crop) // 2
    mean, std = (np.array(v) for v in fixed.NORM_PRESETS["imagenet"])
    for i, j in ((0, 0), (crop // 2, crop // 3), (crop - 1, crop - 1)):
        wide = _one_value(pixels, cols, 1, x0 + j)
        value = _one_value(wide, rows, 0, y0 + i)
        expected = (value / 255 - mean) / std
        assert np.allclose(tensor[:, i, j], expected, atol=1.01 / 255 / std.min())


def test_tensors_of_mixed_sizes_in_one_batch(spark):
    """Every value of coloured, non-square and grey images, against the dense filter matrix."""
    rng = np.random.default_rng(8)
    shapes = [(40, 70, 3), (70, 40, 3), (40, 70, 3), (64, 64, 1), (33, 200, 4), (24, 24, 3), (300, 41, 3), (40, 70, 1)]
    images = [rng.integers(0, 256, shape).astype(np.uint8) for shape in shapes]
    df = spark.createDataFrame([(i, *p.shape, bytearray(p.tobytes())) for i, p in enumerate(images)],
                               "path int, height int, width int, channels int, data binary").coalesce(1)
    found = {r.path: np.asarray(r.tensor, np.float32) for r in scoring.prepare_tensors(df, 30, 24, "half").collect()}
    assert len(found) == len(images)

    def dense(source, size):
        scale = source / size
        k, at = np.arange(source), np.arange(size)[:, None]
        w = np.clip(1 - np.abs(k + 0.5 - (at + 0.5) * scale) / max(scale, 1.0), 0, None)
        return w / w.sum(1, keepdims=True)

    for i, p in enumerate(images):
        rgb = (p[..., 2::-1] if p.shape[2] >= 3 else np.repeat(p, 3, 2)).astype(float)
        scale = 30 / min(p.shape[:2])
        rows, cols = (max(24, int(np.floor(s * scale + 0.5))) for s in p.shape[:2])
        y, x = (rows - 24) // 2, (cols - 24) // 2
        whole = np.einsum("yh,xw,hwc->cyx", dense(p.shape[0], rows)[y:y + 24], dense(p.shape[1], cols)[x:x + 24], rgb)
        level = np.round((found[i].reshape(3, 24, 24).astype(float) * 0.5 + 0.5) * 255)
        assert np.abs(level - whole).max() <= 0.5 + 1e-6


def _largest_batch(df):
    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})
    return df.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]


@pytest.mark.parametrize("step", [scoring.prepare_tensors, degenerate.image_stats, forensics.with_chunks])
def test_wide_rows_come_in_small_batches(spark, step):
    """A worker's memory does not grow with the rows of its task; a bound of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    images = spark.range(600).coalesce(1).selectExpr(
        "CAST(id AS STRING) AS path", "40 AS height", "1000 AS width", "1 AS channels",
        "CAST(repeat('x', 40000) AS BINARY) AS data", "data AS content")
    spark.conf.unset(name)
    step(images)
    assert _largest_batch(images.select("path", "data")) <= 2 * session.BATCH_BYTES
    spark.conf.set(name, "1000000")
    step(images)
    assert spark.conf.get(name) == "1000000" and _largest_batch(images.select("path", "data")) <= 2_000_000
    spark.conf.unset(name)


@pytest.mark.parametrize("side, channels, crop", [(8, 1, 224), (64, 1, 24), (500, 3, 24), (3000, 1, 224)])
def test_stacks_stay_small(side, channels, crop):
    """Neither the pixels nor the tensors of images that are resampled together pass some megabytes."""
    data = bytes(side * side * channels)
    batch = pa.RecordBatch.from_pydict({"path": list(range(40)), "height": [side] * 40, "width": [side] * 40,
                                        "channels": [channels] * 40, "data": [data] * 40})
    stacks = list(scoring._one_size(batch, crop))
    assert sorted(i for rows, _ in stacks for i in rows) == list(range(40))
    assert all(len(rows) == 1 or max(pixels.size, len(rows) * 3 * crop * crop * 8) <= scoring.STACK_BYTES
               for rows, pixels in stacks)


def test_no_images(spark):
    df = spark.createDataFrame([], "path int, height int, width int, channels int, data binary")
    assert scoring.prepare_tensors(df).count() == 0


def test_score_table_marks_unusable_inputs(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [0.0, None])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    scored = scoring.score_table(df, scoring.linear_scorer([1.0, 10.0], 0.5), "x", ["id"], width=2)
    z = {r.id: r.z for r in scored.collect()}
    assert z == {1: 21.5, 2: None, 3: None, 4: None}
