"""Nearest neighbours through several shifted Hilbert curves.

Equal vectors are one node, which keeps the few smallest ids a search can return. For each
curve, nodes are projected on other random directions, cut into cells of equal share, with
the cuts shifted, and put in the order of the Hilbert curve through the cells. Spark ranks
each order and cuts it into blocks. A query looks at its own block and its neighbours on
every curve, measures exact distances there and merges the nearest. Its windows then double
on all curves until ``QUIET`` doublings in a row bring nothing new among its nearest, so
vectors with close neighbours stop early and vectors without any go on, at last over all
blocks. A task merges what it finds for a query over all its blocks before it is shuffled.

The projections' cuts come from ``SAMPLE`` nodes, those with the smallest digests; every
vector is indexed. Vectors that have no nearer neighbours than most, such as random
directions in many dimensions, are found only by looking at a good part of the table.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do vectors of another length than the most frequent one; a null id is never a
query nor returned; with few vectors all others are returned; ties go to the smaller id;
rows that repeat an id are one candidate; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgaudit.llm.common import flat_bytes, written
from imgaudit.operators.ranking import with_position

CURVES, DIMENSIONS, BITS, BLOCK = 16, 8, 4, 512
SAMPLE, QUIET = 4096, 2
HELD = 200_000  # found rows that a task holds before it merges them


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cell coordinates."""
    x = cells.T.astype(np.int64).copy()
    for bit in reversed(range(1, bits)):
        low = (1 << bit) - 1
        for i in range(len(x)):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in reversed(range(1, bits)):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in reversed(range(bits)):
        for row in x:
            key = (key << 1) | ((row >> bit) & 1)
    return key


class Curves:
    """Directions and cell bounds of every curve."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int):
        rng = np.random.default_rng(7)
        size, self.bits = sample.shape[1], bits
        dimensions = min(dimensions, size)
        self.directions = [np.linalg.qr(rng.standard_normal((size, size)))[0][:, :dimensions]
                           for _ in range(curves)]
        cells = 1 << bits
        self.bounds = []
        for i, directions in enumerate(self.directions):
            shift = (i / curves - 0.5) / cells  # the cuts of each curve lie elsewhere
            shares = np.clip(np.arange(1, cells) / cells + shift, 0, 1)
            self.bounds.append(np.quantile(sample @ directions, shares, axis=0))

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        for directions, bounds in zip(self.directions, self.bounds):
            projected = vectors @ directions
            cells = np.stack([np.searchsorted(bounds[:, j], projected[:, j], "right")
                              for j in range(projected.shape[1])], axis=1)
            yield hilbert_keys(cells, self.bits)


def _matrix(column, kind: str) -> np.ndarray:
    data, offsets = flat_bytes(column)
    rows = len(offsets) - 1
    return data.view(kind).reshape(rows, -1).astype(np.float64) if rows else np.zeros((0, 1))


def find_nodes(embeddings: DataFrame, keep: int, vec_id: str,
               embedding: str) -> tuple[DataFrame, DataFrame, str]:
    """Ids with their vector's digest; distinct vectors with their smallest ids; number format."""
    kind = embeddings.select(embedding).schema[0].dataType.elementType.simpleString()
    number = "<f4" if kind == "float" else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float32() if number == "<f4" else pa.float64())
            values = flat.to_numpy(zero_copy_only=False).astype(number) + 0  # -0 becomes 0
            size = np.diff(lists.offsets.to_numpy())
            cuts = np.concatenate([[0], np.cumsum(size)])
            raw = values.tobytes()
            width = values.itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([raw[a * width:b * width] for a, b in zip(cuts, cuts[1:])],
                                           pa.binary())], ["vec_id", "vector"])

    value = F.col(embedding)
    usable = (value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(value, lambda x: x != 0) & F.col(vec_id).isNotNull())
    rows = embeddings.filter(usable).select(
        F.col(vec_id).cast("long"), value.cast("array<float>" if kind == "float" else "array<double>"))
    packed = written(rows.mapInArrow(pack, "vec_id long, vector binary").withColumn(
        "node", F.md5("vector")), "vectors")
    size = packed.groupBy(F.octet_length("vector").alias("bytes")).agg(F.count(F.lit(1)).alias("n"))
    size = size.orderBy(F.desc("n"), "bytes").first()
    packed = packed.filter(F.octet_length("vector") == (size.bytes if size else 0))
    # the limit per node applies on the map side, so a very common vector moves a few rows
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = packed.select("node", "vec_id").distinct().withColumn("at", place).filter(F.col("at") <= keep)
    ids = few.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = packed.groupBy("node").agg(F.first("vector").alias("vector"))
    nodes = written(ids.join(vectors, "node"), "nodes")
    return packed.select("vec_id", "node"), nodes, number


def index_blocks(nodes: DataFrame, number: str, curves: int, dimensions: int, bits: int,
                 block: int) -> tuple[DataFrame, DataFrame]:
    """Where every node lies on every curve, and the blocks, one row each."""
    sample = nodes.orderBy("node").limit(SAMPLE).select("vector").collect()
    fitted = Curves(np.frombuffer(b"".join(r.vector for r in sample), number).reshape(
        len(sample), -1).astype(np.float64), curves, dimensions, bits)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for curve, key in enumerate(fitted.keys(_matrix(batch["vector"], number))):
                yield pa.RecordBatch.from_arrays(
                    [batch["node"], pa.array(np.full(len(key), curve), pa.int32()), pa.array(key)],
                    ["node", "curve", "key"])

    keyed = written(nodes.select("node", "vector").mapInArrow(keys, "node string, curve int, key long"),
                    "keys")
    placed = with_position(keyed, ["key", "node"], ["curve"]).select(
        "node", "curve", F.floor(F.col("position") / block).cast("long").alias("block"))
    placed = written(placed, "places")
    vectors = nodes.select("node", "vector", F.col("ids")[0].alias("first_id"))
    members = F.sort_array(F.collect_list(F.struct("first_id", "node", "vector")))
    blocks = placed.join(vectors, "node").groupBy("curve", "block").agg(members.alias("members"))
    return placed, written(blocks, "blocks")


def nearest(query: np.ndarray, vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the nearest vectors of each query, ties to the earlier place."""
    places, distances = [], []
    for row in query:
        far = np.sqrt(((vectors - row) ** 2).sum(axis=1))
        best = np.argsort(far, kind="stable")[:count]
        places.append(best)
        distances.append(far[best])
    return places, distances


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id",
               embedding: str = "embedding", curves: int = CURVES, dimensions: int = DIMENSIONS,
               bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """For each vector whose id is divisible by ``every``: its ``k`` nearest others, with distances."""
    members, nodes, number = find_nodes(embeddings, k + 1, vec_id, embedding)
    asked = members.filter(F.col("vec_id") % every == 0).distinct()
    spark = embeddings.sparkSession
    if nodes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed, blocks = index_blocks(nodes, number, curves, dimensions, bits, block)
    open_ = asked.select("node").distinct().join(nodes.select("node", "vector"), "node")
    open_ = written(open_.withColumn("quiet", F.lit(0)), "queries")
    at = placed.join(open_.select("node"), "node")
    at = written(at.select("node", "curve", F.col("block").alias("home")), "homes")
    last = blocks.agg(F.max("block")).first()[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(b"".join(m["vector"] for m in row["members"]), number)
                queries = np.frombuffer(b"".join(q["vector"] for q in row["queries"]), number)
                vectors = vectors.reshape(len(row["members"]), -1).astype(np.float64)
                queries = queries.reshape(len(row["queries"]), -1).astype(np.float64)
                places, far = nearest(queries, vectors, k + 1)
                counts = [len(p) for p in places]
                place = np.concatenate(places)
                held.append(pd.DataFrame({
                    "query": np.repeat(np.array([q["node"] for q in row["queries"]], object), counts),
                    "node": np.array([m["node"] for m in row["members"]], object)[place],
                    "first_id": np.array([m["first_id"] for m in row["members"]])[place],
                    "score": np.concatenate(far)}))
                rows += len(place)
                if rows > HELD:
                    held = [merged(held)]
                    rows = len(held[0])
                    if rows > HELD // 2:  # that many queries: pass on what there is
                        yield pa.RecordBatch.from_pandas(held[0], preserve_index=False)
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(merged(held), preserve_index=False)

    def merged(found: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(found).drop_duplicates(["query", "node"])
        return whole.sort_values(["query", "score", "first_id", "node"]).groupby("query").head(k + 1)

    best, reach = None, 0
    while True:
        low, reach = reach, 2 * reach + 1 if reach else 1
        ring = F.sequence(F.col("home") - reach, F.col("home") + reach)
        new = F.filter(ring, lambda b: (b >= 0) & (b <= last) & (
            (F.abs(b - F.col("home")) > low) | F.lit(low == 0)))
        requests = at.join(open_, "node").select(
            "curve", F.explode(new).alias("block"), F.struct("node", "vector").alias("query"))
        grouped = requests.groupBy("curve", "block").agg(F.collect_list("query").alias("queries"))
        found = grouped.join(blocks, ["curve", "block"]).select("members", "queries").mapInArrow(
            measure, "query string, node string, first_id long, score double").withColumn("new", F.lit(True))
        if best is not None:
            found = found.unionByName(best.withColumn("new", F.lit(False)))
        found = found.groupBy("query", "node", "first_id").agg(
            F.min("score").alias("score"), F.min("new").alias("new"))
        order = Window.partitionBy("query").orderBy("score", "first_id", "node")
        ranked = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
        ranked = written(ranked.drop("at"), "nearest")
        best = ranked.drop("new")
        if reach >= last:
            break
        changed = ranked.groupBy(F.col("query").alias("node")).agg(F.count_if("new").alias("n"))
        quiet = F.when(F.col("n") > 0, 0).otherwise(F.col("quiet") + 1)
        open_ = open_.join(changed, "node").select("node", "vector", quiet.alias("quiet"))
        open_ = written(open_.filter(F.col("quiet") < QUIET), "queries")
        if open_.isEmpty():
            break
    listed = best.join(nodes.select("node", "ids"), "node").select(
        "query", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(
        listed, "query").filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
