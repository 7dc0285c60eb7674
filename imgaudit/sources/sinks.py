"""Partitioned writes and stages that run once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgaudit.session import stored
from imgaudit.sources.claims import Claim
from imgaudit.sources.files import exists, remove, rename


def materialize(df: DataFrame, root: str, mode: str = "error") -> None:
    """Kept images as Parquet by subset and class, the bytes in a binary column."""
    named = df.withColumn("cls", F.when(F.col("label") == 1, "fake").otherwise("real"))
    named.write.mode(mode).partitionBy("subset", "cls").parquet(root)


def run_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], lease: float = 60.0,
              poll: float = 1.0) -> DataFrame:
    """Build and write a table unless a finished write is already there; then read it.

    Of several drivers one builds, under a claim beside the table, and the others wait. If it is
    lost, its claim runs out after ``lease`` seconds and another takes over. A table is written
    to a folder of its driver's own and gets its name when it is complete, so a driver that
    comes back late changes nothing; a broken write is done again.
    """
    done, claim = f"{path}/_SUCCESS", Claim(spark, f"{path}-claim", lease)
    while not exists(spark, done):
        if not claim.take():
            time.sleep(poll)
            continue
        try:
            if not exists(spark, done):
                own = f"{path}-{claim.owner}"
                build().write.mode("overwrite").parquet(own)
                if claim.held():
                    if not exists(spark, done):
                        remove(spark, path)
                        rename(spark, own, path)
                remove(spark, own)
        finally:
            claim.release()
    return spark.read.parquet(path)


def run_stages(spark: SparkSession, root: str, stages: Mapping[str, Callable[[], DataFrame]],
               only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Run all stages, or the named ones, in order."""
    return {name: run_stage(spark, f"{root}/{name}", stages[name])
            for name in (only if only is not None else stages)}


def write_partial(df: DataFrame, root: str, part: str = "gid") -> None:
    """Replace the partitions present in ``df`` and keep the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        part).parquet(root)


def merge_partials(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def write_logits(df: DataFrame, root: str, mode: str = "error") -> None:
    """One folder per model tag and view."""
    df.write.mode(mode).partitionBy("model_tag", "view").parquet(root)


def write_files(df: DataFrame, root: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's bytes as a file below a folder that all executors share.

    Files get their names when they are complete, so a task may be repeated. Returns the
    number of files per task, as a written table.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        done, made = 0, set()
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                target = f"{top}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(body.as_buffer())
                system.move(part, target)
                done += 1
        yield pa.RecordBatch.from_pydict({"files": [done]})

    return stored(df.select(name, content).filter(F.col(content).isNotNull()).mapInArrow(
        write, "files long"), "files")


def write_summary(df: DataFrame, path: str, mode: str = "error") -> None:
    """Metric rows as JSON; one small row per view."""
    df.coalesce(1).write.mode(mode).json(path)
