"""Tables, working files and byte helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imgaudit.session import configure, shared_dir


ARROW_BYTES = "8m"  # of a batch that is passed to Python


def prepared(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, as the operators' arrays are some times larger."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return configure(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A whole Parquet table, through Spark's own reader, so any Hadoop path works."""
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit("")).cast("binary")


def aside(documents: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The table under inner column names, which meet no others, and those of the given columns."""
    names = [f"column_{i}" for i in range(len(documents.columns))]
    return documents.toDF(*names), [names[documents.columns.index(c)] for c in columns]


def rows_left(documents: DataFrame, dropped: DataFrame, repeated: DataFrame, text: str,
              doc_id: str) -> DataFrame:
    """The rows but for the dropped ones, and one of each of the repeated; all columns as they were.

    Both tables name rows by ``doc_id`` and ``text_hash`` (xxhash64 of the text's bytes).
    """
    inner, (own_text, own_id) = aside(documents, text, doc_id)
    inner = inner.withColumn("_row", F.struct(F.col(own_id).cast("long").alias("i"),
                                              F.xxhash64(as_bytes(own_text)).alias("h")))
    row = F.struct(F.col("doc_id").cast("long").alias("i"), F.col("text_hash").alias("h"))
    dropped = written(dropped.select(row.alias("_gone")), "dropped")
    left = inner.join(dropped, F.col("_row") == F.col("_gone"), "left_anti")
    repeated = written(repeated.select(row.alias("_again")), "repeated")
    if not repeated.isEmpty():
        same = F.col("_row") == F.col("_again")
        left = left.join(repeated, same, "left_anti").unionByName(
            left.join(repeated, same, "left_semi").dropDuplicates(["_row"]))
    return left.drop("_row").toDF(*documents.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, and the n + 1 offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) \
        if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; equal inputs stay equal, different ones stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered; other bytes, also those of longer code points, unchanged."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span [start, end), from running polynomial sums.

    The spans must be sorted by their start; a megabyte of bytes is summed at a time.
    """
    out = np.empty(len(start), np.uint64)
    block = start // _BLOCK
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(start)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        low, high = int(start[a]), int(end[a:b].max())
        size = 1 << (high - low).bit_length()
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(mix(data[low:high].astype(np.uint64) + np.uint64(1))
                  * _powers(_BASE, size)[:high - low], out=sums[1:], dtype=np.uint64)
        first, last = start[a:b] - low, end[a:b] - low
        out[a:b] = mix((sums[last] - sums[first]) * _powers(_INVERSE, size)[first]
                       + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose binary column holds about ``limit`` bytes; a longer row is one run."""
    _, offsets = flat_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not white space.

    White space is the space and the bytes 9 to 13; no run crosses a row.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = inside & (~before | edge[:-1])
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = inside & (~after | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
