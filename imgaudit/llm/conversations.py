"""Cheapest repair of conversation structure over a suffix-shared automaton (DAWG).

A conversation's rows, in order, become one letter each: who speaks (the role's initial ``s``,
``u``, ``a``, or ``o`` for any other) in lower case, in upper case if the text is truncated, and
``x`` for a row that has to go (blank or duplicate). Conversations that end alike share the
nodes of their ends: a node of the automaton is a distinct remaining signature, and holds the
cost-to-go and the best audit for each state of the role grammar ``(s?(ua)+)?``. Signatures of
all conversations are range-partitioned and sorted from their ends, so equal remainders lie side
by side; the nodes of the current one form a stack, each is computed once and popped when no
later signature can share it.

Any conversation may be as long as the table. Rows are put in order by one range shuffle, which
deals long conversations over many tasks, and cut into blocks of at most ``ROWS`` rows and about
``BYTES`` bytes. For a block inside a conversation a node holds costs and audits from every
state to every state; inserts stand before rows only, so two audits of a block never begin each
other, and their order decides ties before anything behind the block could. What then remains
per long conversation is 32 small numbers per block, folded from its end. A hash runs over one
conversation in order, hence by one task, which streams the blocks and holds one at a time.

Defined cases: a null role or text is one space, so that text is blank and that role ``o``; a
null id is a conversation of its own, a null turn comes first; rows of equal turn are ordered by
a hash of role and text, equal rows after each other; an empty role has no initial and counts as
``o``; a conversation left without rows gives zeros, an empty audit and the hash of the empty
text; a gap count beyond the largest long is that long; a text of any length is read whole, one
row at a time; repeated rows are duplicates; an empty table gives no rows; other columns are not
read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import partitions, written

ROWS, BYTES = 1024, 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK = r"[\x20\x09-\x0D]"
MOST = (1 << 63) - 1

# The role grammar: state 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EXPECTED = (("u", 2), ("u", 2), ("a", 3), ("u", 2))  # the turn to insert or to make, and what follows
ENDING = (0, 2, 1, 0)  # inserts that end a conversation
STATES = range(4)

BLOCK = ("conv_id long, part int, no int, signature string, roles array<string>, texts array<string>, "
         "digests array<binary>, places array<int>, blank long, duplicate long, illegal long, "
         "initials string, rows int, turns long, low long, high long")
SOLVED = ("conv_id long, part int, no int, first boolean, last boolean, cost array<long>, "
          "rank array<int>, audit array<string>")
CHOSEN = "conv_id long, part int, no int, entry int, pick int, total long"
AUDITS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string")
REPAIRED = "conv_id long, place long, role string, text string, edit string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
          "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
          "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(zip(*rows), fields)],
                                      [name for name, _ in fields])


# ------------------------------------------------------------------ rows

def plain(conversations: DataFrame) -> DataFrame:
    """Rows to be repaired as they are: id, turn, role, text, and whether the row is gone."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(False).alias("gone"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that hashes of id and turn call for; dropped rows are marked gone."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = plain(conversations).withColumn("_kind", F.crc32(key.cast("binary")) % 20)
    kind, text = F.col("_kind"), F.col("text")
    damaged_text = (F.when(kind == 0, "").when(kind == 1, "")
                    .when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                       damaged_text.alias("text"), (kind == 0).alias("gone"),
                       F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("_copies"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("_copies").alias("_copy")).drop("_copy")


# ------------------------------------------------------------------ blocks

class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None, part: int, no: int):
        self.key = conv_id, part, no
        self.letters, self.roles, self.texts = [], [], []
        self.seen, self.digests, self.places = set(), [], []
        self.blank = self.duplicate = self.size = self.turns = 0
        self.low = self.high = None

    def full(self) -> bool:
        return len(self.letters) >= ROWS or self.size >= BYTES

    def add(self, turn: int | None, role: str, text: str, blank: bool, late: bool, digest: bytes) -> None:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if blank:
            self.blank += 1
            letter = "x"
        elif (role, text) in self.seen:
            self.duplicate += 1
            letter = "x"
        else:
            self.seen.add((role, text))
            self.digests.append(digest)
            self.places.append(len(self.letters))
            letter = letter.upper() if late else letter
        self.letters.append(letter)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text) + 64
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def row(self) -> tuple:
        initials = [role[:1] for role in self.roles]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        # an initial may be empty: a space keeps the ends of the block apart from "no rows"
        ends = (initials[0] or "\0") + (initials[-1] or "\0") if initials else ""
        return (*self.key, "".join(self.letters), self.roles, self.texts, self.digests, self.places,
                self.blank, self.duplicate, illegal, ends, len(self.letters), self.turns, self.low, self.high)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of a task; a conversation may go on in the next task."""
    block, out, size = None, [], 0
    for batch in batches:
        for part, conv, turn, role, text, gone, blank, late, digest in zip(
                *(batch.column(i).to_pylist() for i in range(9))):
            if block is None or block.key[0] != conv or block.full():
                no = 0
                if block is not None:
                    out.append(block.row())
                    size += block.size
                    no = block.key[2] + 1
                    if size >= BYTES or len(out) >= 10_000:
                        yield _batch(out, BLOCK)
                        out, size = [], 0
                block = _Block(conv, part, no)
            if not gone:
                block.add(turn, role, text, blank, late, digest)
    if block is not None:
        out.append(block.row())
    if out:
        yield _batch(out, BLOCK)


def blocks(rows: DataFrame) -> DataFrame:
    """The rows in order, cut into bounded blocks, on shared files."""
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    order = ["conv_id", "turn", "_digest", "_id"]
    # the number spreads equal rows over tasks; which of them comes first makes no difference
    placed = rows.withColumn("_digest", digest).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ready = placed.select(F.spark_partition_id(), "conv_id", "turn", "role", "text", "gone",
                          ~F.col("text").rlike(rf"[^\x20\x09-\x0D]"),
                          ~F.col("text").rlike(rf"[.!?]{BLANK}*\z"), "_digest")
    named = ready.toDF("part", "conv_id", "turn", "role", "text", "gone", "blank", "late", "digest")
    return written(named.mapInArrow(_cut, BLOCK), "conversation-blocks")


def _key(column: str = "conv_id") -> Column:
    return F.struct(F.col(column))  # never null, and equal to itself


def _narrow(cut: DataFrame) -> DataFrame:
    """Blocks without texts, with their place in the conversation and duplicates across blocks."""
    narrow = cut.select(_key().alias("_key"), "conv_id", "part", "no", "signature")
    at = F.struct("part", "no")
    ends = narrow.groupBy("_key").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    narrow = narrow.join(ends, "_key").select(
        "_key", "conv_id", "part", "no", "signature", (at == F.col("_first")).alias("first"),
        (at == F.col("_last")).alias("last"))
    split = ends.filter("_first < _last").select("_key")
    place = F.struct("part", "no", "place")
    seen = cut.select(_key().alias("_key"), "part", "no", F.arrays_zip("digests", "places").alias("_rows")).join(
        split, "_key").select("_key", "part", "no", F.explode("_rows").alias("_row")).select(
        "_key", "part", "no", F.col("_row.digests").alias("digest"), F.col("_row.places").alias("place"))
    firsts = seen.groupBy("_key", "digest").agg(F.min(place).alias("_at"), F.count(F.lit(1)).alias("_n"))
    again = seen.join(firsts.filter("_n > 1").drop("_n"), ["_key", "digest"]).filter(place > F.col("_at"))
    again = again.groupBy("_key", "part", "no").agg(F.collect_list("place").alias("_again"))
    marked = narrow.join(again, ["_key", "part", "no"], "left")
    signature = F.when(F.col("_again").isNull(), F.col("signature")).otherwise(F.expr(
        "array_join(transform(split(signature, ''), (c, i) -> if(array_contains(_again, i), 'x', c)), '')"))
    return marked.select("conv_id", "part", "no", "first", "last", signature.alias("signature"),
                         F.coalesce(F.array_size("_again"), F.lit(0)).alias("again"))


# ------------------------------------------------------------------ the automaton

@cache
def _moves(letter: str) -> list[list[tuple[int, str, int]]]:
    """For every state the ways to pass a row: cost, edits, and the state behind it."""
    late = TRUNCATED if letter.isupper() else 0
    ways = []
    for first in STATES:
        found, state = [], first
        for inserts in range(3 if first < 2 else 2):  # more only lead back to a state had for less
            cost, edits = INSERT * inserts, "I" * inserts
            found.append((cost + DELETE, edits + "D", state))
            if letter != "x":
                kept = KEEP.get((state, letter.lower()))
                if kept is not None:
                    found.append((cost + late, edits + "K", kept))
                found.append((cost + late + REROLE, edits + "R", EXPECTED[state][1]))
            state = EXPECTED[state][1]
        ways.append(found)
    return ways


def _root(last: bool) -> list[list[tuple[int, str] | None]]:
    """Behind the last row: to the end of the conversation, or to the state that is there."""
    if last:
        return [[(INSERT * ENDING[state], "I" * ENDING[state])] for state in STATES]
    return [[(0, "") if state == goal else None for goal in STATES] for state in STATES]


def _node(letter: str, behind: list[list]) -> list[list[tuple[int, str] | None]]:
    """Cost-to-go and least audit per state and goal, from those of the node behind."""
    node = []
    for ways in _moves(letter):
        goals = []
        for goal in range(len(behind[0])):
            least, audits = None, []
            for cost, edits, state in ways:
                rest = behind[state][goal]
                if rest is None:
                    continue
                if least is None or cost + rest[0] < least:
                    least, audits = cost + rest[0], []
                if cost + rest[0] == least:
                    audits.append((edits, rest[1]))
            goals.append(None if least is None else (least, min(a + b for a, b in audits)))
        node.append(goals)
    return node


class Automaton:
    """The nodes of one signature's ends; signatures come sorted by their reverse."""

    def __init__(self, last: bool):
        self.nodes, self.ends, self.built = [_root(last)], "", 0

    def of(self, signature: str) -> list[list]:
        ends = signature[::-1]
        shared = len(commonprefix([ends, self.ends]))
        del self.nodes[shared + 1:]
        for letter in ends[shared:]:
            self.nodes.append(_node(letter, self.nodes[-1]))
            self.built += 1
        self.ends = ends
        return self.nodes[-1]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automata = {True: Automaton(True), False: Automaton(False)}
    for batch in batches:
        out = []
        for conv, part, no, first, last, signature in zip(*(batch.column(i).to_pylist() for i in range(6))):
            node = automata[last].of(signature)[:1 if first else 4]
            cost, rank, audit = [], [], []
            for goals in node:
                order = sorted(g[1] for g in goals if g)
                for goal in goals:
                    cost.append(goal[0] if goal else None)
                    rank.append(order.index(goal[1]) if goal else None)
                    audit.append(goal[1] if goal else None)
            out.append((conv, part, no, first, last, cost, rank, audit))
            if len(out) >= 500:
                yield _batch(out, SOLVED)
                out = []
        if out:
            yield _batch(out, SOLVED)


def _fold(blocks_of_one: pa.Table) -> pa.Table:
    """The way through a conversation of several blocks: state before each, and the audit's place."""
    rows = sorted(zip(*(blocks_of_one[c].to_pylist() for c in ("part", "no", "cost", "rank"))))
    rest, choices = [0], []
    for part, no, cost, rank in reversed(rows):
        width = len(rest)
        ways = [min((cost[at + goal] + rest[goal], rank[at + goal], goal) for goal in range(width)
                    if cost[at + goal] is not None and rest[goal] is not None)
                for at in range(0, len(cost), width)]
        rest = [way[0] for way in ways]
        choices.append([way[2] for way in ways])
    out, entry, total = [], 0, rest[0]
    conv = blocks_of_one["conv_id"][0].as_py()
    for (part, no, cost, _), choice in zip(rows, reversed(choices)):
        goal = choice[entry]
        width = len(cost) // len(choice)
        out.append((conv, part, no, entry, entry * width + goal, total))
        entry, total = goal, None
    return pa.Table.from_batches([_batch(out, CHOSEN)])


def solve(cut: DataFrame) -> DataFrame:
    """Per block: the state before it, its audit, and on the first one the conversation's cost."""
    narrow = written(_narrow(cut), "conversation-signatures")
    by_end = narrow.select("conv_id", "part", "no", "first", "last", "signature",
                           F.reverse("signature").alias("_end"))
    order = ["last", "_end", "conv_id", "part", "no"]
    by_end = by_end.repartitionByRange(partitions(cut.sparkSession), *order).sortWithinPartitions(*order)
    solved = written(by_end.drop("_end").mapInArrow(_solve, SOLVED), "conversation-solutions")
    whole = solved.filter("first and last").select(
        "conv_id", "part", "no", F.lit(0).alias("entry"), F.col("audit")[0].alias("audit"),
        F.col("cost")[0].alias("total"))
    some = solved.filter("not (first and last)")
    chosen = some.groupBy(_key().alias("_key")).applyInArrow(_fold, CHOSEN).withColumn("_key", _key())
    parts = chosen.join(some.select(_key().alias("_key"), "part", "no", "audit"), ["_key", "part", "no"]).select(
        "conv_id", "part", "no", "entry", F.expr("audit[pick]").alias("audit"), "total")
    counts = narrow.select(_key().alias("_key"), "part", "no", "again", F.length(
        F.regexp_replace("signature", "[a-z]", "")).cast("long").alias("late"))
    ways = whole.unionByName(parts).withColumn("_key", _key())
    return ways.join(counts, ["_key", "part", "no"]).drop("_key")


# ------------------------------------------------------------------ results

def _edited(entry: int, audit: str, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """The repaired rows of a block with the edits that made them."""
    state, at = entry, 0
    for edit in audit:
        role, after = EXPECTED[state]
        if edit == "I":
            yield ROLES[role], "", edit
            state = after
            continue
        if edit == "K":
            yield roles[at], texts[at], edit
            state = KEEP[state, roles[at][:1]]
        elif edit == "R":
            yield ROLES[role], texts[at], edit
            state = after
        at += 1


class _Conversation:
    """What is known of a conversation after some of its blocks."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.initial, self.started, self.rows = conv_id, None, False, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.low = self.high = None
        self.audit, self.hash = [], hashlib.sha256()

    def add(self, way: dict, block: dict) -> list[tuple]:
        self.blank += block["blank"]
        self.duplicate += block["duplicate"] + way["again"]
        self.truncated += way["late"]
        self.illegal += block["illegal"]
        if block["rows"]:
            first, last = (c.replace("\0", "") for c in block["initials"])
            self.illegal += self.initial is not None and self.initial + first not in LEGAL
            self.initial = last
        if block["low"] is not None:
            self.turns += block["turns"] - (block["low"] == self.high)
            self.low = block["low"] if self.low is None else self.low
            self.high = block["high"]
        self.cost += way["total"] or 0
        self.audit.append(way["audit"])
        out = []
        for role, text, edit in _edited(way["entry"], way["audit"], block["roles"], block["texts"]):
            self.hash.update(("\n" if self.started else "").encode() + f"{role}:{text}".encode())
            out.append((self.conv_id, self.rows, role, text, edit))
            self.started = True
            self.rows += 1
        return out

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


def _follow(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Conversations from their ways and blocks in order: audits, or the repaired rows."""
    conversation, way, out = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if conversation is None or conversation.conv_id != row["conv_id"]:
                if conversation is not None and not texts:
                    out.append(conversation.row())
                conversation = _Conversation(row["conv_id"])
            if row["audit"] is not None:
                way = row
            else:
                repaired = conversation.add(way, row)
                out += repaired if texts else []
            if len(out) >= (ROWS if texts else 10_000):
                yield _batch(out, REPAIRED if texts else AUDITS)
                out = []
    if conversation is not None and not texts:
        out.append(conversation.row())
    if out:
        yield _batch(out, REPAIRED if texts else AUDITS)


def _results(rows: DataFrame, texts: bool) -> DataFrame:
    cut = blocks(rows)
    ways = solve(cut)
    bodies = cut.drop("signature", "digests", "places")
    both = ways.unionByName(bodies, allowMissingColumns=True).withColumn(
        "_body", F.col("audit").isNull())  # a way comes before its block
    placed = both.repartition(partitions(cut.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "part", "no", "_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _follow(batches, texts)

    return placed.mapInArrow(run, REPAIRED if texts else AUDITS)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cost and edits of the cheapest repair, a hash of it."""
    return _results(rows, texts=False)


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations, in order, each with the edit that made it."""
    return _results(rows, texts=True)
