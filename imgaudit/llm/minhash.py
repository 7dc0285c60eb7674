"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one node. A signature has ``HASHES`` values, and the
forest has ``TREES`` sorted orders of all signatures, each starting at another value. Nodes
with the same first ``DEPTH`` values of an order form a region. A region with more than
``REGION`` nodes is cut by longer prefixes, where it is crowded and only there, until its
parts are small enough for a task; so depth adapts to each region.

Candidates of the first round are neighbours in an order, which have the longest common
prefixes, and the leader of the region; pairs whose signatures agree too little are left
out. Links are confirmed on full sets. The second round takes every region whose nodes are
still in several components, with their sets and in blocks: a node outside the region's main
component is compared with all others, inside the tasks and without a row per pair. Both
sides are cut into chunks, and a block is a pair of chunks, whatever the region holds. So no
link of a region is missed, however large it is, while a crowded group of near copies is
mostly one component after the first round and costs little in the second.

Defined cases: a text without words, empty or null has the empty set and is linked with
nothing; one to four words are one shingle; a row with a null id is read, but stands for
itself: its component is null and it is kept; rows that repeat an id are each linked by their
own text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import (
    as_bytes, flat_bytes, lower_ascii, mix, partitions, rows_left, slices, span_hashes, words, written)

SHINGLE = 5
HASHES, TREES, DEPTH = 64, 16, 4
DEEPER = (8, 16, 32, 64)
REGION = 2048
HELD = 1 << 22  # shingle holders that a task opens at a time
NEIGHBOURS = 2
LEAST_AGREEING = 40  # of 64; a pair at the 0.85 threshold has fewer with probability 1e-4
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)

SIGNED = "doc_id long, text_hash long, n_shingles long, node binary, signature binary"
PAIRS = "a binary, b binary"


# ------------------------------------------------------------------ sets and signatures

def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, sorted by row."""
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    word = span_hashes(data, start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    full = np.flatnonzero(row[SHINGLE - 1:] == row[:len(row) - SHINGLE + 1]) \
        if len(row) >= SHINGLE else np.zeros(0, np.int64)
    chain = np.zeros(len(full), np.uint64)
    for step in range(SHINGLE):
        chain = mix(chain + word[full + step])
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    short = count[few].astype(np.uint64)
    for step in range(SHINGLE - 1):
        there = np.minimum(first[few] + step, len(word) - 1)
        short = np.where(step < count[few], mix(short + word[there] if len(word) else short), short)
    rows = np.concatenate([row[full], few])
    hashes = np.concatenate([chain, short])
    order = np.argsort(mix(hashes ^ mix(rows.astype(np.uint64) + np.uint64(1))))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    kept = np.sort(order[fresh])
    kept = kept[np.argsort(rows[kept], kind="stable")]
    return rows[kept], hashes[kept]


def sign(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes, 128-bit node numbers and signatures of ``n`` rows."""
    size = np.bincount(rows, minlength=n)
    filled = np.flatnonzero(size)
    node = np.zeros((n, 2), np.uint64)
    signature = np.zeros((n, HASHES), np.uint32)
    if len(filled):
        first = (np.cumsum(size) - size)[filled]
        for column, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            node[filled, column] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), first)
        for column, factor in enumerate(FACTORS):
            low = np.minimum.reduceat(hashes * factor, first)
            signature[filled, column] = low >> np.uint64(32)
    return size, node, signature


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(values), [
        None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "body"):
            size, node, signature = sign(*shingle_sets(*flat_bytes(part["body"])), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["text_hash"], pa.array(size, pa.int64()), _fixed(node), _fixed(signature)],
                [c.split()[0] for c in SIGNED.split(", ")])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and sorted shingle hashes of every text that still has its node's set."""
    for batch in batches:
        for part in slices(batch, "body"):
            rows, hashes = shingle_sets(*flat_bytes(part["body"]))
            size, node, _ = sign(rows, hashes, part.num_rows)
            hashes = hashes[np.lexsort((hashes, rows))]
            own = np.split(hashes, np.cumsum(size)[:-1])
            same = [i for i, want in enumerate(part["node"].to_pylist()) if want == node[i].tobytes()]
            yield pa.RecordBatch.from_pydict(
                {"node": [node[i].tobytes() for i in same], "body": [own[i].tobytes() for i in same]},
                pa.schema([("node", pa.binary()), ("body", pa.binary())]))


# ------------------------------------------------------------------ forest

def region_key(depth: int):
    """Hash of the first ``depth`` values of the row's order."""
    turned = F.concat(F.col("signature"), F.col("signature"))
    at = F.col("tree") * F.lit(4 * HASHES // TREES) + 1
    return F.xxhash64("tree", F.substring(turned, at, F.lit(4 * depth)))


def plant(nodes: DataFrame) -> DataFrame:
    """Nodes that have company: tree, region, and part (the region, cut deeper where crowded).

    Regions are found on keys alone; signatures join in only where a region has two nodes.
    """
    trees = F.explode(F.array(*[F.lit(t) for t in range(TREES)]))
    keyed = nodes.select("node", "signature", trees.alias("tree")).select(
        "node", "tree", region_key(DEPTH).alias("region"))
    sizes = keyed.groupBy("tree", "region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(keyed.join(sizes, ["tree", "region"]), "regions").join(nodes, "node")
    members = members.select("tree", "region", "size", "node", "signature")
    leaves, crowded = None, members.withColumn("part", F.col("region"))
    for depth in (*DEEPER, None):
        small = crowded.filter(F.col("size") <= REGION)
        leaves = small if leaves is None else leaves.unionByName(small)
        large = crowded.filter(F.col("size") > REGION)
        if large.isEmpty():
            break
        if depth is None:  # equal signatures throughout: cut by node, the leader links the parts
            leaves = leaves.unionByName(large.withColumn("part", F.xxhash64(
                "part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / REGION)))))
            break
        deeper = written(large.withColumn("part", region_key(depth)).drop("size"), "crowded")
        counts = deeper.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"))
        crowded = deeper.join(counts, ["tree", "part"])
    return written(leaves.select("tree", "region", "part", "node", "signature"), "forest")


def _signatures(column) -> np.ndarray:
    return flat_bytes(column)[0].view("<u4").reshape(-1, HASHES)


def _pair_batch(node: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    names = np.array(node.to_pylist(), object)
    low, high = names[a], names[b]
    turn = low > high
    low, high = np.where(turn, high, low), np.where(turn, low, high)
    return pa.RecordBatch.from_pydict({"a": low.tolist(), "b": high.tolist()},
                                      pa.schema([("a", pa.binary()), ("b", pa.binary())]))


def _agree(signature: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs agree in enough values; some thousands at a time."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 65536):
        same = signature[a[at:at + 65536]] == signature[b[at:at + 65536]]
        out[at:at + 65536] = same.sum(axis=1) >= LEAST_AGREEING
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of near neighbours in sorted parts; the rows before a batch are carried along."""
    tail = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        old = 0 if tail is None else tail.num_rows
        rows = rows if tail is None else pa.concat_tables([tail, rows])
        part = np.array(rows["part"]) ^ np.array(rows["tree"])
        signature = _signatures(rows["signature"])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(NEIGHBOURS, len(part) - 1) + 1):
            a = np.flatnonzero(part[:-step] == part[step:])
            a = a[a + step >= old]
            left.append(a)
            right.append(a + step)
        a, b = np.concatenate(left), np.concatenate(right)
        good = _agree(signature, a, b)
        yield _pair_batch(rows["node"], a[good], b[good])
        tail = rows.slice(max(0, rows.num_rows - NEIGHBOURS))


def _across(percent: int):
    """All links across components inside the blocks of a task's sorted rows."""

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, root = np.unique(np.array(rows["root"].to_pylist(), object), return_inverse=True)
        side = np.array(rows["side"])
        data, offsets = flat_bytes(rows["body"])
        shingle, offsets = data.view(np.uint64), offsets // 8
        size = np.diff(offsets)
        order = np.argsort(shingle)
        holder = np.repeat(np.arange(len(size)), size)[order]
        ordered = shingle[order]
        for i in np.flatnonzero(side != 1):
            partners = (side == 1) | ((side == 2) & (side[i] == 2) & (np.arange(len(side)) > i))
            partners &= (root != root[i]) & (
                100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
            if not partners.any():
                continue
            own = shingle[offsets[i]:offsets[i + 1]]
            low = np.searchsorted(ordered, own, "left")
            count = np.searchsorted(ordered, own, "right") - low
            same, step = np.zeros(len(size), np.int64), max(1, HELD // len(size))
            for at in range(0, len(own), step):
                first, n = low[at:at + step], count[at:at + step]
                held = holder[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                same += np.bincount(held, minlength=len(size))
            linked = (100 * same >= percent * (size[i] + size - same)) & partners
            if linked.any():  # one per component is enough to join them
                partner = np.flatnonzero(linked)
                partner = partner[np.unique(root[partner], return_index=True)[1]]
                yield _pair_batch(rows["node"], np.full(len(partner), i), partner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            key = np.array(batch["block"])
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and key[a] != block:
                    yield from links(pa.concat_tables(held))
                    held = []
                block = key[a]
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield from links(pa.concat_tables(held))

    return run


def first_candidates(forest: DataFrame) -> DataFrame:
    """Neighbours in every order, and the leader of every region with each of its nodes."""
    width = partitions(forest.sparkSession)
    turned = F.concat("signature", "signature")
    order = F.substring(turned, F.col("tree") * F.lit(4 * HASHES // TREES) + 1, F.lit(4 * HASHES))
    near = (forest.repartition(width, "tree", "part").sortWithinPartitions("tree", "part", order, "node")
            .select("tree", "part", "node", "signature").mapInArrow(_neighbours, PAIRS))
    leaders = forest.groupBy("tree", "region").agg(
        F.min_by(F.struct("node", "signature"), "node").alias("leader"),
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > NEIGHBOURS)
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(HASHES - 1)), F.lit(0), lambda total, i: total + F.when(
            F.substring("signature", 4 * i + 1, F.lit(4))
            == F.substring("leader.signature", 4 * i + 1, F.lit(4)), 1).otherwise(0))
    led = forest.join(leaders.drop("n"), ["tree", "region"]).filter(
        (F.col("leader.node") < F.col("node")) & (same >= LEAST_AGREEING)).select(
        F.col("leader.node").alias("a"), F.col("node").alias("b"))
    return near.unionByName(led).filter("a < b").distinct()


# ------------------------------------------------------------------ links and components

def confirmed(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; sets are computed for these nodes only."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # sets differ in size by no more than the threshold allows
    size = nodes.select(F.col("node").alias("_node"), "n_shingles")
    for end in "ab":
        pairs = pairs.join(size, F.col(end) == F.col("_node")).drop("_node").withColumnRenamed(
            "n_shingles", f"_{end}")
    fits = 100 * F.least("_a", "_b") >= percent * F.greatest("_a", "_b")
    pairs = written(pairs.filter(fits).select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = full_sets(ends, nodes, documents)
    x, y = (sets.select(F.col("node").alias(end), F.col("body").alias(name))
            for end, name in (("a", "x"), ("b", "y")))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, PAIRS),
                   "links")


def full_sets(wanted: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Sorted shingle hashes of the wanted nodes, from the whole text of one document each."""
    ids = wanted.distinct().join(nodes.select("node", F.col("first_id").alias("_id")), "node")
    bodies = documents.join(ids, F.col("doc_id") == F.col("_id")).select("node", "body").mapInArrow(
        _set_batches, "node binary, body binary")
    return written(bodies.groupBy("node").agg(F.first("body").alias("body")), "sets")


def links_across(forest: DataFrame, roots: DataFrame, nodes: DataFrame, documents: DataFrame,
                 percent: int) -> DataFrame:
    """Links between components, found in every region that still holds several.

    The region's main component and the nodes outside of it are cut into chunks. A block holds
    two chunks outside, or one outside and one of the main component, so each such pair meets
    in one block. Side 0 meets side 1; side 2 meets side 1 and itself.
    Regions in which the first round looked at every pair need no second look.
    """
    width = partitions(forest.sparkSession)
    placed = forest.join(roots, "node", "left").select(
        "tree", "region", "node", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("tree", "region", "root").agg(F.count(F.lit(1)).alias("n"))
    several = shares.groupBy("tree", "region").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("members"),
        F.max("n").alias("most"),
        F.count(F.lit(1)).alias("roots")).filter(
        (F.col("roots") > 1) & (F.col("members") > NEIGHBOURS + 1)).drop("roots")
    open_ = written(placed.join(several, ["tree", "region"]), "open")
    sets = full_sets(open_.select("node"), nodes, documents)
    mains = F.greatest(F.ceil(F.col("most") / REGION), F.lit(1)).cast("int")
    others = F.ceil((F.col("members") - F.col("most")) / REGION).cast("int")

    def block(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    def numbers(count):
        return F.sequence(F.lit(0), count - 1)

    mine = F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("main"), mains).otherwise(others)).cast("int")
    own = F.col("mine")
    as_main = F.transform(numbers(others), lambda k: block("main", k, own, F.lit(1)))
    as_other = F.concat(
        F.transform(numbers(mains), lambda m: block("main", own, m, F.when(m == 0, 2).otherwise(0))),
        F.transform(F.filter(numbers(others), lambda k: k != own), lambda k: block(
            "others", F.least(own, k), F.greatest(own, k), F.when(own < k, 0).otherwise(1))))
    at = F.explode(F.when(F.col("root") == F.col("main"), as_main).otherwise(as_other))
    spread = open_.withColumn("mine", mine).select("tree", "region", "node", "root", at.alias("at"))
    blocked = spread.select(F.xxhash64("tree", "region", "at.kind", "at.i", "at.j").alias("block"),
                            "node", "root", "at.side")
    return written(blocked.join(sets, "node").repartition(width, "block")
                   .sortWithinPartitions("block", "node").select("block", "node", "root", "side", "body")
                   .mapInArrow(_across(percent), PAIRS).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """The smallest node each linked node can reach: ``node``, ``root``.

    Every node takes the smallest root among its own and its neighbours', then the root of
    that root, until nothing changes; distances halve with each pass.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        hooked = roots.join(near, "node").select(
            "node", F.col("root").alias("_old"), F.least("root", "_near").alias("_to"))
        above = roots.select(F.col("node").alias("_to"), F.col("root").alias("_up"))
        jumped = hooked.join(above, "_to").select(
            "node", "_old", F.least("_to", "_up").alias("root"))
        new = written(jumped, "roots")
        if new.filter("root < _old").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def _classes(documents: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """Per document: id, hash of its text, size of its set, root of its component, and least id there."""
    plain = documents.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("body"))
    hashed = plain.select("doc_id", F.xxhash64("body").alias("text_hash"), "body")
    signed = written(hashed.mapInArrow(_sign_batches, SIGNED), "signed")
    linkable = signed.filter("n_shingles > 0 and doc_id is not null")
    nodes = written(linkable.groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")), "nodes")
    forest = plant(nodes.select("node", "signature"))
    links = confirmed(first_candidates(forest), nodes, plain, percent)
    roots = components(links)
    across = links_across(forest, roots, nodes, plain, percent)
    if not across.isEmpty():
        roots = components(links.unionByName(across))
    named = nodes.select("node", "first_id").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("_least"))
    found = named.join(least, "root").select(F.col("node").alias("_node"), "root", "_least")
    joined = signed.join(found, (F.col("node") == F.col("_node")) & F.col("doc_id").isNotNull()
                         & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "text_hash", "n_shingles", "root",
                         F.coalesce("_least", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    percent: int = 85) -> DataFrame:
    """Per document: size of its set, smallest id of its component, and whether that is its own."""
    return _classes(documents, text, doc_id, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id",
                     percent: int = 85) -> DataFrame:
    """One document of each component; all columns as they were.

    Rows are told apart by id and text. If several rows of a component have its least id, the
    one with the least hash of its text stays; equal rows count as one.
    """
    found = written(_classes(documents, text, doc_id, percent).drop("n_shingles", "component_id"), "classes")
    linked = found.filter("kept and root is not null")
    several = linked.groupBy("root").agg(F.min("text_hash").alias("_least"), F.count(F.lit(1)).alias("_n")).filter(
        "_n > 1").withColumnRenamed("root", "_root")
    shared = linked.join(several, F.col("root") == F.col("_root"))
    dropped = found.filter("not kept").unionByName(shared.filter("text_hash != _least").select(*found.columns))
    again = shared.filter("text_hash = _least").groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return rows_left(documents, dropped, again, text, doc_id)
