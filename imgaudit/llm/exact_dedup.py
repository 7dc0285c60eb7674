"""Exact duplicates by an extendible-hash index on shared files.

Every text has a 64-bit key; the leading bits of the key choose a slot of the directory,
and a slot points to a bucket. A bucket with more bytes of distinct keys than its capacity
is split by one more bit; when it already uses all bits of the directory, the directory
doubles first. Buckets are thus key ranges, and each has one owner task. An owner reads its
entries in key order, chains the texts that share a key, compares them byte by byte, and
writes one index record per distinct text. Copies inside one input batch are merged before
anything is shuffled, and an owner holds one key's chain at a time, so a text that makes up
a third of all rows costs one entry per batch and no memory.

Defined cases: a null text counts as empty; all empty texts are copies of each other; rows
that repeat an id with the same text count in the group size and share one decision; a null
id is smaller than any other; an empty table gives an empty result; other columns are
neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import as_bytes, partitions, rows_left, written

ENTRY = "_key long, _text binary, _top long, _n long"
BATCH_BYTES = 32 << 20


class Directory:
    """Buckets by leading key bits; a bucket of few bits has a run of slots, one of all bits one.

    A bucket is its local depth and that many leading bits, so its slots are a range that need
    not be written down: doubling the directory costs nothing and a split makes two buckets.
    """

    def __init__(self, local: np.ndarray, prefix: np.ndarray) -> None:
        """Buckets in the order of their keys."""
        self.local, self.prefix = local, prefix
        self.depth = int(local.max(initial=0))

    @property
    def slots(self) -> list[int]:
        """The bucket of every slot, written out."""
        return np.repeat(np.arange(len(self.local)), 1 << (self.depth - self.local)).tolist()

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """The buckets of 64-bit keys, as their leading bits fall into the buckets' ranges."""
        if not self.depth:
            return np.zeros(len(keys), np.int64)
        slot = (keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)
        first = self.prefix << (self.depth - self.local)
        return np.searchsorted(first, slot, "right") - 1


def grow(counts: Mapping[int, int], bits: int, capacity: int) -> Directory:
    """Split from one bucket until none is overfull; counts: bytes by leading ``bits`` bits.

    All overfull buckets of a depth are split at once. A bucket's bytes are a difference of
    running sums, so a split costs a binary search, whatever the size of the directory.
    """
    keys = np.fromiter(counts.keys(), np.int64, len(counts))
    order = np.argsort(keys)
    keys = keys[order]
    below = np.concatenate([[0], np.cumsum(np.fromiter(counts.values(), np.int64, len(counts))[order])])

    def size(prefix: np.ndarray, depth: int) -> np.ndarray:
        ends = [np.searchsorted(keys, (prefix + step) << (bits - depth)) for step in (0, 1)]
        return below[ends[1]] - below[ends[0]]

    full, kept = np.zeros(1, np.int64), []
    for depth in range(bits + 1):
        over = size(full, depth) > capacity if depth < bits else np.zeros(len(full), bool)
        kept.append((np.full((~over).sum(), depth), full[~over]))
        full = (2 * full[over][:, None] + np.arange(2)).ravel()
        if not len(full):
            break
    local, prefix = (np.concatenate(c).astype(np.int64) for c in zip(*kept))
    order = np.argsort(prefix << (local.max(initial=0) - local), kind="stable")
    return Directory(local[order], prefix[order])


def build_directory(keyed: DataFrame, capacity: int) -> Directory:
    """The directory for all rows of ``keyed`` (``_key``, ``_size``), from bytes per prefix.

    The histogram has a few prefixes per bucket, as many as the index has buckets, each of
    ``capacity`` bytes: the driver gets and the tasks hold some numbers per bucket.
    """
    distinct = written(keyed.groupBy("_key").agg(F.max("_size").alias("_size")), "keys")
    total = distinct.agg(F.sum("_size")).first()[0] or 0
    capacity = max(1, min(capacity, total // (4 * partitions(keyed.sparkSession)) + 1))
    bits = min(40, (2 * total // capacity).bit_length())
    prefix = F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long")
    counts = distinct.groupBy(prefix.alias("p")).agg(F.sum("_size").alias("s")).toArrow()
    return grow(dict(zip(counts["p"].to_pylist(), counts["s"].to_pylist())), bits, capacity)


def _merge(entries: pa.Table) -> pa.Table:
    """One row per key and text; the group-by compares the bytes of texts with equal keys."""
    merged = entries.group_by(["_key", "_text"], use_threads=False).aggregate(
        [("_top", "max"), ("_n", "sum")])
    return merged.rename_columns(["_key", "_text", "_top", "_n"]).cast(entries.schema)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge copies among the rows of a task, some megabytes at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > BATCH_BYTES:
            yield from _merge(pa.Table.from_batches(held)).to_batches()
            held, size = [], 0
    if held:
        yield from _merge(pa.Table.from_batches(held)).to_batches()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's entries in key order: one record per distinct text of every key."""
    chain = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if chain is None else pa.concat_tables([chain, rows])
        if not rows.num_rows:
            continue
        last = rows["_key"][rows.num_rows - 1]
        still = pc.equal(rows["_key"], last)
        yield from _merge(rows.filter(pc.invert(still))).to_batches()
        chain = _merge(rows.filter(still))
    if chain is not None:
        yield from chain.to_batches()


def build_index(documents: DataFrame, text: str = "text", doc_id: str = "doc_id",
                capacity: int = BATCH_BYTES) -> DataFrame:
    """The index as a table on shared files: key, text, its hash, largest id, copies."""
    body = as_bytes(text)
    rows = documents.select(F.xxhash64(body).alias("_key"), body.alias("_text"),
                            F.col(doc_id).cast("long").alias("_top"), F.lit(1).cast("long").alias("_n"))
    directory = build_directory(
        rows.select("_key", F.octet_length("_text").cast("long").alias("_size")), capacity)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merge_batches(batches):
            keys = batch.column("_key").to_numpy(zero_copy_only=False)
            yield batch.append_column("_bucket", pa.array(directory.bucket(keys), pa.int64()))

    owned = (rows.mapInArrow(merged, ENTRY + ", _bucket long")
             .repartition(partitions(documents.sparkSession), "_bucket")
             .sortWithinPartitions("_key").drop("_bucket"))
    chained = owned.mapInArrow(_chain, ENTRY)
    return written(chained.withColumn("_sha256", F.sha2("_text", 256)), "index")


def _decided(documents: DataFrame, text: str, doc_id: str, capacity: int) -> DataFrame:
    index = build_index(documents, text, doc_id, capacity)
    body = as_bytes(text)
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("_key"),
                              F.sha2(body, 256).alias("_sha256"))
    return narrow.join(index.drop("_text"), ["_key", "_sha256"]).select(
        "doc_id", F.col("_key").alias("text_hash"), F.col("_top").alias("keep_id"),
        F.col("_n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_top")).alias("kept"),
        F.col("_sha256").alias("text_sha256"))


def exact_groups(documents: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 capacity: int = BATCH_BYTES) -> DataFrame:
    """Per document: the id that stays for its text, the group's size, and the text's hash."""
    return _decided(documents, text, doc_id, capacity).drop("text_hash")


def drop_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of every text, with the id that stays; all columns as they were.

    Rows are told apart by id and text, so rows of other texts that share an id are not touched.
    """
    found = written(_decided(documents, text, doc_id, BATCH_BYTES).select(
        "doc_id", "text_hash", "kept", "group_size").filter("group_size > 1"), "decided")
    again = found.filter("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows_left(documents, found.filter("not kept"), again, text, doc_id)
