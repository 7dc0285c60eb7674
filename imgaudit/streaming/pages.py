"""Page counts of an endless stream: windows that end, folded into a compacted base table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgaudit import fixed_values as fixed
from imgaudit.session import stored
from imgaudit.sources.files import names, remove

COUNTS = ("analyzed", "flagged")


def windowed_page_stats(events: DataFrame, time: str = "ts", delay: str = "1 day", window: str = "1 hour",
                        threshold: float = fixed.FLAG_THRESHOLD) -> DataFrame:
    """Analysed and flagged images per page and window of event time, for the update mode.

    State holds the windows that end after the newest event less ``delay``. Rows that come
    later than that are dropped, and counted in the query's progress.
    """
    opened = F.window(time, window)
    counted = events.withWatermark(time, delay).groupBy(opened.alias("_window"), "page").agg(
        F.count("score").alias("analyzed"), F.count_if(F.col("score") >= threshold).alias("flagged"))
    return counted.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), "page", *COUNTS)


class PageTotals:
    """Totals per page from window updates, in tables that stay small.

    A batch merges its updates into the open windows and writes those that are still open;
    windows that can change no more are summed per page and added. Every so many batches all
    that was added is folded into one base table, and what went into it is removed when the
    next base stands. Each batch writes folders of its own, so it may be repeated.
    """

    opened = "start timestamp, end timestamp, page long, analyzed long, flagged long"
    total = "page long, analyzed long, flagged long"

    def __init__(self, root: str, delay: str, every: int = 10):
        self.root, self.delay, self.every = root, delay, every

    def _ids(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches whose folder of a kind is complete."""
        found = [int(n.removeprefix(f"{kind}-")) for n in names(spark, self.root) if n.startswith(f"{kind}-")]
        return sorted(i for i in found if "_SUCCESS" in names(spark, f"{self.root}/{kind}-{i}"))

    def _read(self, spark: SparkSession, kind: str, ids: list[int], schema: str) -> DataFrame:
        paths = [f"{self.root}/{kind}-{i}" for i in ids]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _upto(self, spark: SparkSession, batch_id: int, bases: list[int]) -> DataFrame:
        """What was closed by a batch: the last base and the additions since."""
        base = bases[-1:]
        added = [i for i in self._ids(spark, "closed") if max(base, default=-1) < i <= batch_id]
        return self._read(spark, "base", base, self.total).unionByName(
            self._read(spark, "closed", added, self.total))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [i for i in self._ids(spark, "open") if i < batch_id][-1:]
        both = self._read(spark, "open", before, self.opened).withColumn("_new", F.lit(0)).unionByName(
            batch.select("start", "end", "page", *COUNTS).withColumn("_new", F.lit(1)))
        merged = stored(both.groupBy("start", "end", "page").agg(
            F.max_by(F.struct(*COUNTS), "_new").alias("_row")).select("start", "end", "page", "_row.*"), "windows")
        # the newest event is no older than its window's start, so the watermark is no less than this
        horizon = merged.select(F.max("start") - F.expr(f"INTERVAL {self.delay}")).scalar()
        over = F.coalesce(F.col("end") <= horizon, F.lit(False))
        _summed(merged.filter(over)).write.mode("overwrite").parquet(f"{self.root}/closed-{batch_id}")
        merged.filter(~over).write.mode("overwrite").parquet(f"{self.root}/open-{batch_id}")
        remove(spark, f"{self.root}/open-{batch_id - 2}")
        if (batch_id + 1) % self.every == 0:
            older = [i for i in self._ids(spark, "base") if i < batch_id]
            _summed(self._upto(spark, batch_id, older)).write.mode("overwrite").parquet(f"{self.root}/base-{batch_id}")
            for i in older[:-1]:
                remove(spark, f"{self.root}/base-{i}")
            for i in self._ids(spark, "closed"):
                if i <= max(older, default=-1):
                    remove(spark, f"{self.root}/closed-{i}")

    def read(self, spark: SparkSession) -> DataFrame:
        """Totals per page up to the last batch, open windows included."""
        last = self._ids(spark, "open")[-1:]
        opened = self._read(spark, "open", last, self.opened).select("page", *COUNTS)
        upto = max(last, default=-1)
        bases = [i for i in self._ids(spark, "base") if i <= upto]
        return _summed(self._upto(spark, upto, bases).unionByName(opened))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page").agg(*[F.sum(c).alias(c) for c in COUNTS])
