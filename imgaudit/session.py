"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from imgaudit.sources.files import remove

# Runtime settings the operators count on. Adaptive execution is on by default in
# Spark 4; it is named here because the equi-joins lean on its skew splitting.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


#: Bytes of one Arrow batch of files or images that goes to Python. Spark's own bound is 64 MB; a
#: worker holds several copies of a batch, so its memory would grow with the rows of a task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of wide rows, unless the session names a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


_made: dict[str, str] = {}  # folders made here, by application


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _made:
        _made[context.applicationId] = tempfile.mkdtemp(prefix="imgaudit-")
    return _made[context.applicationId]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    A cluster must name that folder: a driver's own would be another one on every machine.
    Only with a local master, as in tests, where there is one machine, is one made.
    """
    return os.path.join(_root(spark), "imgaudit", spark.sparkContext.applicationId,
                        f"{name}-{uuid.uuid4().hex}")


def clear(spark: SparkSession) -> None:
    """Remove all working tables of this application; its results must have been written.

    Operators return lazy tables that read their working tables when they run, so only the
    caller knows when these are no longer needed.
    """
    remove(spark, os.path.dirname(shared_dir(spark, "any")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is used several times to the shared folder and read it back.

    Work done so far is not repeated, and a lost executor costs no earlier stage.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
