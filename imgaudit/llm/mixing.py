"""Sources interleaved to target weights by Pfair scheduling.

The documents of each source are put in a random but repeatable order and cut into blocks.
A source of weight w releases block j at time floor(j / w) and must have it placed by time
ceil((j + 1) / w); in every slot, of the released blocks the one with the earliest deadline
is placed. All deadlines are met, so at every time each source has its share of the slots
to within less than one block. Where weights rounded to whole slots of ``PERIOD`` keep all
blocks inside the windows of the unrounded weights, the driver plans one period and repeats
it. Otherwise it plans every block from the unrounded weights, one block of each source at a
time, and writes the plan in parts. Spark places the blocks by a join with the plan.

The shares hold up to the slot at which the first source has run out; ``in_mix`` marks the
blocks before it. Later blocks keep their slots and fill up the rest, and none is dropped.

Defined cases: a null source is a source of its own; a source that the weights do not name
gets weight 0, is not in the mix and follows after it; repeated rows are placed each; an
empty table gives no rows; a weight must not be negative; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import partitions, written
from imgaudit.operators.ranking import with_position

BLOCK, PERIOD = 16, 1000
PLANNED = 1 << 20  # blocks of a plan that the driver holds


def whole_slots(weights: Mapping, period: int) -> dict:
    """Slots per period by largest remainder; every positive weight gets at least one."""
    positive = {name: w for name, w in weights.items() if w > 0}
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    if not positive:
        return {}
    period = max(period, len(positive))
    total = sum(positive.values())
    ideal = {name: w / total * period for name, w in positive.items()}
    slots = {name: max(1, int(share)) for name, share in ideal.items()}
    order = sorted(ideal, key=lambda name: (slots[name] - ideal[name], repr(name)))
    while sum(slots.values()) < period:
        name = min(order, key=lambda n: (slots[n] - ideal[n], repr(n)))
        slots[name] += 1
    while sum(slots.values()) > period:
        name = max((n for n in order if slots[n] > 1), key=lambda n: (slots[n] - ideal[n], repr(n)))
        slots[name] -= 1
    return slots


def schedule(slots: Mapping) -> list[tuple]:
    """One period as (name, block of the period, slot), by earliest deadline first."""
    period = sum(slots.values())
    releases = sorted((j * period // n, repr(name), name, j) for name, n in slots.items() for j in range(n))
    ready, planned, at = [], [], 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            _, key, name, j = releases[at]
            heapq.heappush(ready, (-(-(j + 1) * period // slots[name]), key, j, name))
            at += 1
        deadline, _, j, name = heapq.heappop(ready)
        assert slot < deadline, "a deadline is missed"
        planned.append((name, j, slot))
    return planned


def whole_weights(weights: Mapping) -> dict:
    """Integers in exactly the ratios of the positive weights."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is negative")
    exact = {name: Fraction(w) for name, w in weights.items() if w > 0}
    scale = lcm(*(w.denominator for w in exact.values()))
    return {name: int(w * scale) for name, w in exact.items()}


def keeps_windows(plan: list[tuple], slots: Mapping, weights: Mapping, blocks: Mapping) -> bool:
    """Whether the repeated period puts every block, and the first a source lacks, in its exact window.

    The distance to a window changes evenly with the periods, so the first and last decide.
    """
    period, total = sum(slots.values()), sum(weights.values())
    for name, j, slot in plan:
        if j <= blocks[name]:
            for turn in (0, (blocks[name] - j) // slots[name]):
                before, at = turn * slots[name] + j, turn * period + slot
                if not 0 < weights[name] * (at + 1) - before * total < total + weights[name]:
                    return False
    return True


def exact_schedule(weights: Mapping, blocks: Mapping) -> Iterator[tuple]:
    """All blocks, and the first each source lacks, as (name, block, slot), by earliest deadline."""
    total = sum(weights.values())
    waiting, ready, slot = [(0, repr(name), name, 0) for name in weights], [], 0
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, key, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[name]), key, name, j))
        deadline, key, name, j = heapq.heappop(ready)
        assert slot < deadline, "a deadline is missed"
        yield name, j, slot
        if j < blocks[name]:
            heapq.heappush(waiting, ((j + 1) * total // weights[name], key, name, j + 1))
        slot += 1


def source_sizes(documents: DataFrame, source: str) -> dict:
    """Documents per source; one row per source reaches the driver, as the weights do."""
    rows = documents.groupBy(F.col(source).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return {r.s: r.n for r in rows.collect()}


def tempered(sizes: Mapping, power: float) -> dict:
    """Weights that draw sources together: sizes to a power below 1."""
    return {name: n ** power for name, n in sizes.items()}


def place(documents: DataFrame, weights: Mapping | None = None, power: float = 0.7,
          source: str = "source", doc_id: str = "doc_id", block: int = BLOCK,
          period: int = PERIOD) -> DataFrame:
    """Add ``_block``, ``_slot``, ``_place`` (order in the mix) and ``_in_mix`` to all rows.

    Without weights they are the sources' sizes to the given power.
    """
    spark = documents.sparkSession
    sizes = source_sizes(documents, source)
    weights = tempered(sizes, power) if weights is None else weights
    whole = whole_weights({s: weights.get(s, 0) for s in sizes})
    blocks = {name: -(-sizes[name] // block) for name in whole}  # a last block may be short
    slots = whole_slots({s: weights.get(s, 0) for s in sizes}, period) if len(whole) <= period else {}
    plan = schedule(slots)
    length = max(1, sum(slots.values()))
    if whole and not (plan and keeps_windows(plan, slots, whole, blocks)):
        slots = {name: n + 1 for name, n in blocks.items()}  # the plan does not repeat
        plan = exact_schedule(whole, blocks)
    # the first slot at which a source has no block left
    ends, parts = {}, []
    plan = iter(plan)
    while part := list(islice(plan, PLANNED)):
        for name, j, slot in part:
            if j == blocks[name] % slots[name]:
                ends[name] = blocks[name] // slots[name] * length + slot
        names, turns, at = zip(*part)
        rows = pa.table({"_source": pa.array(names, pa.string()), "_turn": pa.array(turns, pa.int64()),
                         "_at": pa.array(at, pa.int64())})
        parts.append(written(spark.createDataFrame(rows), "plan"))
    horizon = min(ends.values(), default=0)
    planned = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame(
        [], "_source string, _turn long, _at long")
    shares = spark.createDataFrame(list(slots.items()), "_of string, _slots long")
    # inner names must not meet the table's own
    own = {name: f"column_{i}" for i, name in enumerate(documents.columns)}
    renamed = documents.toDF(*own.values()).withColumn(
        "_named", F.struct(F.col(own[source]).cast("string").alias("name")))
    random = F.col(own[doc_id]).cast("string")
    numbered = with_position(renamed, [F.xxhash64(random), random], ["_named"], "_number")
    numbered = numbered.withColumn("_block", F.floor(F.col("_number") / block).cast("long"))
    shared = numbered.join(shares, F.col("_named.name").eqNullSafe(F.col("_of")), "left")
    shared = shared.withColumn("_mine", F.pmod("_block", F.coalesce("_slots", F.lit(1))))
    joined = shared.join(planned, F.col("_named.name").eqNullSafe(F.col("_source"))
                         & (F.col("_mine") == F.col("_turn")), "left")
    regular = F.floor(F.col("_block") / F.col("_slots")) * F.lit(length) + F.col("_at")
    afterwards = F.lit(max(ends.values(), default=0) + length) + F.col("_block")
    joined = joined.withColumn("_slot", F.coalesce(regular, afterwards).cast("long"))
    return joined.select(
        *[F.col(inner).alias(name) for name, inner in own.items()], "_block", "_slot",
        (F.col("_slot") * F.lit(block) + F.pmod("_number", F.lit(block))).alias("_place"),
        (F.col("_slots").isNotNull() & (F.col("_slot") < F.lit(horizon))).alias("_in_mix"))


def mixed(documents: DataFrame, weights: Mapping | None = None, power: float = 0.7,
          source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Per document: source, block within it, slot in the mix, place, and whether shares hold there."""
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    return place(narrow, weights, power, "source", "doc_id").select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"),
        F.col("_place").alias("place"), F.col("_in_mix").alias("in_mix"))


def in_order(documents: DataFrame, weights: Mapping | None = None, power: float = 0.7,
             source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All documents with their columns, laid out in the order of the mix."""
    placed = place(documents, weights, power, source, doc_id)
    width = partitions(documents.sparkSession)
    return placed.repartitionByRange(width, "_place").sortWithinPartitions("_place").select(
        *documents.columns)

