"""Manifests, shard scans, image folders and score files."""

from __future__ import annotations

import errno
import os
import stat
import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imgaudit import schemas
from imgaudit.functions.images import has_extension, is_hidden, parent_name
from imgaudit.session import stored
from imgaudit.sources.files import exists, matches

LISTING_TASKS = 8  # per core, where files are not read
LISTING_ROWS = 10_000  # of one batch
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")


def load_manifests(spark: SparkSession, paths: Sequence[str], missing: str = "error",
                   schema=schemas.MANIFEST) -> DataFrame:
    """Union of manifests with a header row; a missing one fails or is skipped with a warning."""
    if missing == "skip":
        absent = [p for p in paths if not exists(spark, p)]
        for path in absent:
            warnings.warn(f"missing manifest {path}", stacklevel=2)
        paths = [p for p in paths if p not in absent]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).csv(list(paths))


def write_manifest(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("path", "label", "source", "subset").write.mode(mode).option(
        "header", True).csv(path)


def scan_shards(spark: SparkSession, paths: Sequence[str], columns: Sequence[str],
                schema=None) -> DataFrame:
    """Named columns of Parquet shards with ``file`` and ``row_index``, the row order."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths).select(
        *columns, F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_index"))


def with_position(shards: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Scanned shards with each row's number over all files, those of least ``order`` first.

    One row per file is counted and sent to the readers; no wide row is shuffled. File names are
    not compared: ``part-10`` may come after ``part-9``. Files without an ordered row come first.
    """
    files = shards.groupBy("file").agg(F.min(order).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_least", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = shards.join(F.broadcast(starts), "file")
    return placed.select(*shards.columns, (F.col("_start") + F.col("row_index")).alias(name))


@contextmanager
def _folders_listed_by_tasks(spark: SparkSession) -> Iterator[None]:
    """Spark lists up to 32 folders one after the other on the driver; here, from two on, as a job."""
    name = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _list_by_tasks(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Files below mounted folders as Spark's file index finds them, without that index on the driver.

    Each round lists the folders that the round before has found, one row per entry of a written
    table; a task holds one batch of entries, however many a folder has. Left out as by Spark:
    empty files, names that begin with ``.`` or ``_`` (unless ``=`` is in them), files still
    copied, links to nothing.
    """
    rows = LISTING_ROWS

    def left_out(name: str) -> bool:
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    def found(path: str) -> Iterator[tuple[str, str]]:
        """The path itself if it is a file, else the paths in it, each with its last name."""
        local = path.removeprefix("file:")
        if not os.path.isdir(local):
            yield path, os.path.basename(local)
            return
        with os.scandir(local) as entries:
            for entry in entries:
                yield f"{path.rstrip('/')}/{entry.name}", entry.name

    def kept(paths: Iterator[str]) -> Iterator[tuple[str, bool, int, int]]:
        for folder in paths:
            for path, name in found(folder):
                try:
                    path.encode()
                    status = os.stat(path.removeprefix("file:"))
                except UnicodeEncodeError:  # Java cannot open it either
                    continue
                except OSError as error:
                    if error.errno in (errno.ENOENT, errno.ELOOP):
                        continue
                    raise
                is_folder = stat.S_ISDIR(status.st_mode)
                if left_out(name) and not (is_folder and name.startswith(("_metadata", "_common_metadata"))):
                    continue
                if is_folder or status.st_size:
                    yield path, is_folder, status.st_size, status.st_mtime_ns // 1_000_000

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple[str, bool, int, int]] = []
        for row in kept(path for batch in batches for path in batch.column(0).to_pylist()):
            part.append(row)
            if len(part) == rows:
                yield batch_of(part)
                part = []
        yield batch_of(part)

    def batch_of(part: list[tuple[str, bool, int, int]]) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "is_folder": pa.bool_(), "length": pa.int64(), "millis": pa.int64()}
        columns = list(zip(*part, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    folders, count = spark.createDataFrame([(root,) for root in roots], "path string"), len(roots)
    most, levels = LISTING_TASKS * spark.sparkContext.defaultParallelism, []
    while count:
        level = stored(folders.repartition(min(count, most)).mapInArrow(
            listed, "path string, is_folder boolean, length long, millis long"), "listing")
        levels.append(level.filter("NOT is_folder"))
        folders = level.filter("is_folder").select("path")
        count = folders.count()
    return reduce(DataFrame.unionByName, levels).select(
        "path", "length", F.timestamp_millis("millis").alias("modificationTime"))


def scan_image_dir(spark: SparkSession, root: str, prefix: str = "",
                   extensions: tuple[str, ...] = IMAGE_EXTENSIONS,
                   content: bool = True) -> DataFrame:
    """Image files below a folder; ``source`` is a prefix plus the parent folder's name.

    Hidden files are left out. The folders below ``root`` are listed by tasks, however few they
    are. Without ``content`` the files are listed but not read, and on a mounted file system the
    list is a written table, so the driver holds none of it. Otherwise the driver holds one
    status per file, as Spark's file index does.
    """
    roots = [] if content else matches(spark, root)
    if roots and all(path.startswith("file:/") for path in roots):
        files = _list_by_tasks(spark, roots)
    else:
        with _folders_listed_by_tasks(spark):
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.filter(has_extension("path", extensions) & ~is_hidden("path"))
    columns = ["path", "length", "modificationTime"] + (["content"] if content else [])
    if not content:  # Spark deals some thirty files to a partition, as if each were read
        kept = kept.coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism)
    return kept.select(*columns, F.concat(F.lit(prefix), parent_name("path")).alias("source"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: (path, height, width, channels, data), pixels in BGR order."""
    return spark.read.format("image").option("recursiveFileLookup", True).option(
        "dropInvalid", True).load(root).select(
        F.col("image.origin").alias("path"), "image.height", "image.width",
        F.col("image.nChannels").alias("channels"), "image.data")


def read_scores(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(file, score) rows from a JSON array, or from an array under a field."""
    if field is None:
        return spark.read.schema(schemas.GOLDEN).option("multiLine", True).json(path)
    schema = schemas._struct(**{field: schemas.ArrayType(schemas.GOLDEN)})
    return spark.read.schema(schema).option("multiLine", True).json(path).select(
        F.inline(field))
