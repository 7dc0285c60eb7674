"""Micro-batch sinks that may be repeated: each batch owns one folder, named by its id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from imgaudit import schemas
from imgaudit.operators.lookups import valid_cache
from imgaudit.operators.reports import label_changes
from imgaudit.operators.serving import retry_plan
from imgaudit.sources.files import exists, names, remove

BatchWriter = Callable[[DataFrame, int], None]


def start(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """Run a stream into a batch writer; without an interval, until its input is used up."""
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option(
        "checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def drain(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append") -> None:
    start(stream, write, checkpoint, mode).awaitTermination()


def table_writer(root: str) -> BatchWriter:
    """Write each batch as ``batch=<id>`` below a folder; a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return write


def read_table(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(root)


def latest(updates: DataFrame, *keys: str, by: str = "batch") -> DataFrame:
    """The newest update of every key, by batch or by a column."""
    values = [c for c in updates.columns if c not in (*keys, by, "batch")]
    return updates.groupBy(*keys).agg(
        F.max_by(F.struct(*values), by).alias("_row")).select(*keys, "_row.*")


class Mirror:
    """A snapshot of the newest cache entries, kept as one small table per batch.

    Every batch starts from the last snapshot before it, drops what another model made,
    adds urls it does not hold yet and keeps the newest entries. Snapshots older than the
    one it started from are removed.
    """

    schema = "url string, score double, seq long, model_version string"

    def __init__(self, root: str, installed: Callable[[SparkSession], Column | str | None],
                 capacity: int):
        self.root, self.installed, self.capacity = root, installed, capacity

    def path(self, batch_id: int) -> str:
        return f"{self.root}/snapshot-{batch_id}"

    def read(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The snapshot a batch left, or an empty one."""
        if batch_id < 0 or not exists(spark, f"{self.path(batch_id)}/_SUCCESS"):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path(batch_id))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = self.installed(spark)
        stamp = version if isinstance(version, Column) else F.lit(version).cast("string")
        kept = valid_cache(self.read(spark, batch_id - 1), version)
        fresh = batch.filter(F.col("score").isNotNull()).groupBy("url").agg(
            F.min_by("score", "seq").alias("score"), F.min("seq").alias("seq")).withColumn(
            "model_version", stamp)
        added = fresh.join(kept.select("url"), "url", "left_anti")
        # a top-k: every task sends its newest entries only, at most the capacity
        kept.unionByName(added).orderBy(F.desc("seq"), "url").limit(self.capacity).write.mode(
            "overwrite").parquet(self.path(batch_id))
        remove(spark, self.path(batch_id - 2))


class FirstPerUrl:
    """The first successful request of every url, one table per batch.

    A batch adds the urls that no earlier batch has, each with its row that is first in the
    given order. What a batch keeps depends on its rows alone, so it may be repeated.
    """

    def __init__(self, root: str, schema: str, url: str = "url", order: str = "event_id"):
        self.root, self.schema, self.url, self.order = root, schema, url, order

    def read(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, self.root):
            return spark.createDataFrame([], f"{self.schema}, batch long")
        return read_table(spark, self.root, self.schema)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        fields = [c for c in batch.columns if c != self.url]
        first = batch.groupBy(self.url).agg(F.min_by(F.struct(*fields), self.order).alias("_row"))
        known = self.read(batch.sparkSession).filter(F.col("batch") < batch_id).select(self.url)
        first.join(known, self.url, "left_anti").select(self.url, "_row.*").write.mode(
            "overwrite").parquet(f"{self.root}/batch={batch_id}")


class Retries:
    """Retry decisions per image, with the open failures kept as one table per batch.

    Decisions go to ``decisions/batch=<id>``. A batch starts from the failures the one
    before it left open; images without any, and those silent for longer than ``forget``
    before the newest attempt, are not carried: a later failure of theirs counts from one,
    and they are no longer listed as due. All work is done by joins and windows, so a batch of any size spreads
    over the cluster.
    """

    keys = ["page", "url"]
    state = ("page long, url string, failures long, seen timestamp, event_id long, "
             "decision string, due timestamp")

    def __init__(self, root: str, forget: str):
        self.root, self.forget = root, forget

    def path(self, batch_id: int) -> str:
        return f"{self.root}/open-{batch_id}"

    def open_failures(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id < 0 or not exists(spark, f"{self.path(batch_id)}/_SUCCESS"):
            return spark.createDataFrame([], self.state)
        return spark.read.schema(self.state).parquet(self.path(batch_id))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = self.open_failures(spark, batch_id - 1)
        decisions = f"{self.root}/decisions/batch={batch_id}"
        retry_plan(batch, self.keys, "event_id", earlier=earlier).withColumn(
            "due", F.expr("current_timestamp() + make_dt_interval(0, 0, 0, delay_ms / 1000)")
        ).write.mode("overwrite").parquet(decisions)
        last = F.max_by(F.struct("failures", "event_id", "decision", "due"), "event_id")
        newest = spark.read.parquet(decisions).groupBy(*self.keys).agg(
            last.alias("_last"), F.max("ts").alias("seen")).select(
            *self.keys, "_last.failures", "seen", "_last.event_id", "_last.decision", "_last.due")
        carried = earlier.join(newest.select(*self.keys), self.keys, "left_anti").unionByName(
            newest)
        horizon = carried.select(F.max("seen") - F.expr(f"INTERVAL {self.forget}")).scalar()
        carried.filter((F.col("failures") > 0) & (F.col("seen") >= horizon)).write.mode(
            "overwrite").parquet(self.path(batch_id))
        remove(spark, self.path(batch_id - 2))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/decisions")

    def due(self, spark: SparkSession, now: Column | None = None) -> DataFrame:
        """Images whose newest decision is a retry that has come due; reads open failures only."""
        ids = [int(n.removeprefix("open-")) for n in names(spark, self.root) if n.startswith("open-")]
        done = [i for i in ids if exists(spark, f"{self.path(i)}/_SUCCESS")]
        last = self.open_failures(spark, max(done, default=-1))
        return last.filter((F.col("decision") == "retry")
                           & (F.col("due") <= (F.current_timestamp() if now is None else now)))


LABEL_CHANGES = "number long, edited timestamp, klass string, remove array<string>, add array<string>"


def label_writer(root: str, edited: str = "edited") -> BatchWriter:
    """Classify the latest edit of every issue in a batch and write its label changes.

    ``edited`` orders the edits of an issue, such as the time its file was written; it is
    kept, so that ``read_labels`` finds the latest edit whatever batch it came in.
    """
    fields = [f for f in schemas.ISSUE.names if f != "number"]

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("number").agg(
            F.max_by(F.struct(*fields, F.col(edited).alias("_edited")), edited).alias("_edit")).select(
            "number", "_edit.*")
        label_changes(newest).join(newest.select("number", F.col("_edited").alias("edited")), "number"
                                   ).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return write


def read_labels(spark: SparkSession, root: str, schema: str = LABEL_CHANGES) -> DataFrame:
    """The label changes of every issue's latest edit over all batches."""
    return latest(read_table(spark, root, schema), "number", by="edited")
