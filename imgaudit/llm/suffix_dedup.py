"""Removal of long strings that an earlier document has too, by sharded suffix arrays.

A string of ``LENGTH`` bytes is removed from a document if it also starts in a document
with a smaller id. Suffixes are sampled by content: in every string of that length the
position with the smallest hash of ``GRAM`` bytes is an anchor, so equal strings have equal
anchors at equal offsets, and about one position in fourteen is one. The work then goes in
four exchanges, all of them grouped by a shard of documents or by a range of anchors:

1. Each shard of documents sorts its anchors and cuts the sorted run at the owners' bounds.
2. An owner merges the runs by binary search and tells every shard which of its anchors
   occur in no other document, in several, or in very many.
3. Shards send what surrounds shared anchors, once per distinct surrounding, with the
   smallest id that has it. Anchors in very many documents would gather at one owner, so
   for them each string is sent by itself and to the owner of its own hash.
4. Owners compare surroundings byte by byte; where one anchor has several, they build the
   suffix array of these texts by Larsson-Sadakane refinement, take common prefixes of
   neighbours by Kasai's walk, and find for every string the smallest id that has it.

Every shard then marks its bytes. Tasks hold a shard or an owner's share, never a group.

Defined cases: a null or empty text has nothing to remove; a null id counts as smaller than
any other; rows that share an id never remove from each other; a document shorter than
``LENGTH`` stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgaudit.llm.common import as_bytes, aside, flat_bytes, mix, partitions, span_hashes

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM
SHARD_BYTES = 2 << 20
CHUNK = 1 << 18
HOT = 30_000
NO_ID = np.iinfo(np.int64).min
ALONE, SHARED, MANY = 0, 1, 2
NO_ANCHOR = 255

RUNS = "owner int, shard int, kind int, ids binary, sizes binary, body binary"
RESULT = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "removed array<struct<start:long,end:long>>")


# ------------------------------------------------------------------ anchors

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(data)].copy().view(
        ">u8").ravel().astype(np.uint64)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Best of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = best(values[:-step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all rows, some hundred kilobytes at a time."""
    ends = offsets[1:]
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[at:at + CHUNK + LENGTH - 1]
        words = _words(part)
        grams = mix(words[:len(part) - GRAM + 1] + np.uint64(1))
        for step in range(8, GRAM, 8):
            grams = mix((grams ^ words[step:step + len(grams)]) + np.uint64(1))
        grams = np.maximum(grams, 1)  # 0 stands for no string
        starts = np.arange(at, at + len(part) - LENGTH + 1)
        row_end = ends[np.searchsorted(ends, starts, "right")]
        least = np.where(starts + LENGTH <= row_end, _sliding(grams, REACH + 1, np.minimum), 0)
        pad = np.zeros(REACH, np.uint64)
        chosen = np.flatnonzero(
            _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum) == grams)
        places.append(chosen + at)
        hashes.append(grams[chosen])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


class Shard:
    """The documents of one shard: bytes, bounds, ids, anchors and their distinct hashes."""

    def __init__(self, rows: pa.Table, owners: int):
        self.doc_id = rows["doc_id"]
        self.ids = np.array(self.doc_id.fill_null(NO_ID), np.int64)
        self.data, self.offsets = flat_bytes(rows["body"])
        self.place, gram = anchors(self.data, self.offsets)
        self.row = np.searchsorted(self.offsets, self.place, "right") - 1
        self.owner, self.code = _split(gram, owners)
        whole = (self.owner.astype(np.uint64) << np.uint64(32)) | self.code
        self.distinct, self.which = np.unique(whole, return_inverse=True)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of a string around each chosen anchor, inside its document."""
        row, place = self.row[chosen], self.place[chosen]
        return (np.maximum(self.offsets[row], place - REACH),
                np.minimum(place, self.offsets[row + 1] - LENGTH))


def _split(hashes: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    return ((hashes >> np.uint64(32)) % np.uint64(owners)).astype(np.int64), \
        hashes & np.uint64(0xFFFFFFFF)


def _runs(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    names = [c.split()[0] for c in RUNS.split(", ")]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _cuts(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, from, to) of the runs in a sorted owner column."""
    found, first = np.unique(owner, return_index=True)
    return list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(owner)]))


def sort_anchors(rows: pa.Table, owners: int) -> pa.Table:
    """Step 1: a shard's sorted distinct anchors with their document counts, by owner."""
    shard, number = Shard(rows, owners), rows["shard"][0].as_py()
    pairs = np.unique(np.stack([shard.which, shard.ids[shard.row]]), axis=1) \
        if len(shard.which) else np.zeros((2, 0), np.int64)
    docs = np.minimum(np.bincount(pairs[0], minlength=len(shard.distinct)), 65535)
    owner = (shard.distinct >> np.uint64(32)).astype(np.int64)
    code = (shard.distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
    return _runs([(o, number, 0, docs[a:b].astype("<u2").tobytes(), b"", code[a:b].tobytes())
                  for o, a, b in _cuts(owner)])


def merge_runs(rows: pa.Table) -> pa.Table:
    """Step 2: state of every anchor of every run, found by binary search in the merged run."""
    runs = [np.frombuffer(b, "<u4") for b in rows["body"].to_pylist()]
    docs = [np.frombuffer(b, "<u2").astype(np.int64) for b in rows["ids"].to_pylist()]
    merged = np.unique(np.concatenate(runs))
    total = np.zeros(len(merged), np.int64)
    places = [np.searchsorted(merged, run) for run in runs]
    for place, count in zip(places, docs):
        total[place] += count
    state = np.where(total > HOT, MANY, np.where(total > 1, SHARED, ALONE)).astype(np.uint8)
    return _runs([(owner, shard, 0, b"", b"", state[place].tobytes()) for owner, shard, place
                  in zip(rows["owner"].to_pylist(), rows["shard"].to_pylist(), places)])


# ------------------------------------------------------------------ surroundings

class Items:
    """The distinct texts a shard sends: surroundings of shared anchors, strings of hot ones."""

    def __init__(self, shard: Shard, state: np.ndarray, owners: int):
        state = state[shard.which]
        near = np.flatnonzero(state == SHARED)
        first, last = shard.windows(near)
        hot_first, hot_last = shard.windows(np.flatnonzero(state == MANY))
        hot = _ranges(hot_first, hot_last + 1)
        self.start = np.concatenate([first, hot])
        self.end = np.concatenate([last + LENGTH, hot + LENGTH])
        self.row = np.concatenate([shard.row[near],
                                   np.searchsorted(shard.offsets, hot, "right") - 1])
        # where the anchor lies in its surrounding; strings sent by themselves need none
        self.at = np.concatenate([shard.place[near] - first, np.full(len(hot), NO_ANCHOR)])
        text = np.concatenate([span_hashes(shard.data, first, last + LENGTH),
                               span_hashes(shard.data, hot, hot + LENGTH)])
        # a surrounding goes to the owner of its anchor, a string to the owner of itself
        owner = np.concatenate([shard.owner[near], _split(text[len(near):], owners)[0]])
        order = np.lexsort((shard.ids[self.row], text, owner))
        self.start, self.end = self.start[order], self.end[order]
        self.row, self.at = self.row[order], self.at[order]
        owner, text = owner[order], text[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1]) \
            | (np.diff(self.end - self.start) != 0)
        self.lead = np.flatnonzero(fresh)  # the smallest id that has the text
        self.group = np.cumsum(fresh) - 1
        self.owner = owner[self.lead]


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All distinct numbers in the given ranges."""
    if not len(first):
        return np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    first, stop = first[order], stop[order]
    reached = np.concatenate([[np.iinfo(np.int64).min], np.maximum.accumulate(stop)[:-1]])
    first = np.maximum(first, reached)
    size = np.maximum(stop - first, 0)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    return data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _packed(data: np.ndarray) -> bytes:
    """Texts as they are shuffled; half as large as with the shuffle's own compression."""
    return zstandard.compress(data.tobytes(), 3)


def _states(shard: Shard, rows: pa.Table) -> np.ndarray:
    parts = sorted(zip(rows["owner"].to_pylist(), rows["body"].to_pylist()))
    return np.frombuffer(b"".join(body for _, body in parts), np.uint8)


def send_texts(left: pa.Table, right: pa.Table, owners: int) -> pa.Table:
    """Step 3: a shard's distinct texts by owner, and its states for the way back."""
    if not left.num_rows or not right.num_rows:
        return _runs([])
    shard, number = Shard(left, owners), left["shard"][0].as_py()
    state = _states(shard, right)
    items = Items(shard, state, owners)
    start, end = items.start[items.lead], items.end[items.lead]
    ids, at = shard.ids[items.row[items.lead]], items.at[items.lead]
    rows = [(number % owners, number, 1, b"", b"", state.tobytes())]
    for owner, a, b in _cuts(items.owner):
        rows.append((owner, number, 0, ids[a:b].astype("<i8").tobytes(),
                     np.stack([(end - start)[a:b], at[a:b]]).astype(np.uint8).tobytes(),
                     _packed(_gather(shard.data, start[a:b], end[a:b]))))
    return _runs(rows)


# ------------------------------------------------------------------ suffix arrays

def suffix_array(data: np.ndarray) -> np.ndarray:
    """All positions in the order of their suffixes (Larsson-Sadakane refinement).

    Positions start sorted by eight bytes. Each round sorts the members of groups that are
    still together by the rank of what follows, which doubles the sorted length; groups of
    one are left alone.
    """
    words = _words(data)
    order = np.argsort(words, kind="stable")
    rank = np.empty(len(data), np.int64)
    rank[order] = _group_starts(words[order][1:] != words[order][:-1])
    sorted_to = 8
    while True:
        grouped = rank[order]
        alone = np.concatenate([grouped[1:] != grouped[:-1], [True]])
        alone[1:] &= grouped[1:] != grouped[:-1]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return order
        member = order[slots]
        after = member + sorted_to
        # a suffix that has ended comes first, the shorter the earlier
        follow = np.where(after < len(data), rank[np.minimum(after, len(data) - 1)],
                          len(data) - after - 1)
        group = grouped[slots]
        within = np.lexsort((follow, group))
        member, follow, group = member[within], follow[within], group[within]
        order[slots] = member
        changed = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        rank[member] = slots[_group_starts(changed)]
        sorted_to *= 2


def _group_starts(changed: np.ndarray) -> np.ndarray:
    """For each place of a sorted list, the first place of its group."""
    start = np.arange(len(changed) + 1)
    start[1:][~changed] = 0
    return np.maximum.accumulate(start)


def common_prefixes(data: np.ndarray, array: np.ndarray, first: np.ndarray, last: np.ndarray,
                    most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix with the one before it (Kasai's walk).

    ``array`` holds the starts first..last of every text in suffix order. All texts are
    walked side by side in text order: a step to the right shortens the prefix by one, and
    only what lies behind that is compared, eight bytes at a time.
    """
    words = _words(data)
    before = np.full(len(data) + 1, -1, np.int64)
    before[array[1:]] = array[:-1]
    is_start = np.zeros(len(data) + 1, bool)
    is_start[array] = True
    found = np.zeros(len(data), np.int64)
    known, previous = np.zeros(len(first), np.int64), np.full(len(first), -2)
    for step in range(int((last - first).max(initial=-1)) + 1):
        walk = np.flatnonzero(first + step <= last)
        here = first[walk] + step
        there = before[here]
        kept = np.maximum(known[walk] - 1, 0)
        prefix = np.where(is_start[np.maximum(previous[walk] + 1, 0)], kept, 0)
        go = np.flatnonzero((there >= 0) & (prefix < most))
        while len(go):
            a, b = here[go] + prefix[go], there[go] + prefix[go]
            inside = (a < len(data)) & (b < len(data))
            a, b = np.minimum(a, len(data) - 1), np.minimum(b, len(data) - 1)
            differ = words[a] ^ words[b]
            same = np.where(inside, _leading_zero_bytes(differ), 0)
            prefix[go] += same
            go = go[(same == 8) & (prefix[go] < most)]
        found[here] = np.where(there >= 0, np.minimum(prefix, most), 0)
        known[walk], previous[walk] = found[here], there
    return found[array]


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    count = np.zeros(len(x), np.int64)
    for bits in (32, 16, 8):
        top = (x >> np.uint64(64 - bits)) == 0
        count += np.where(top, bits // 8, 0)
        x = np.where(top, x << np.uint64(bits), x)
    return count + (x == 0)


def earlier_strings(data: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per text a bit for every start whose string also occurs in a text of a smaller id."""
    first, last = bounds[:-1], bounds[1:] - LENGTH
    starts = _ranges(first, last + 1)
    is_start = np.zeros(len(data), bool)
    is_start[starts] = True
    array = suffix_array(data)
    array = array[is_start[array]]
    prefix = common_prefixes(data, array, first, last, LENGTH)
    text = np.searchsorted(bounds, array, "right") - 1
    heads = np.flatnonzero(np.concatenate([[True], prefix[1:] < LENGTH]))
    least = np.minimum.reduceat(ids[text], heads)
    least = np.repeat(least, np.diff([*heads, len(array)]))
    bits = np.zeros(len(first), np.uint32)
    hit = least < ids[text]
    np.bitwise_or.at(bits, text[hit],
                     np.uint32(1) << (array[hit] - first[text[hit]]).astype(np.uint32))
    return bits


def compare_texts(rows: pa.Table) -> pa.Table:
    """Step 4: an owner's answer to every shard, a bit per start of every text it sent."""
    rows = rows.sort_by("shard")
    passed = [row for row in zip(*(rows[c].to_pylist() for c in rows.column_names)) if row[2] == 1]
    sent = [row for row in zip(*(rows[c].to_pylist() for c in rows.column_names)) if row[2] == 0]
    if not sent:
        return _runs(passed)
    ids = np.concatenate([np.frombuffer(row[3], "<i8") for row in sent])
    size, at = np.concatenate([np.frombuffer(row[4], np.uint8).reshape(2, -1) for row in sent],
                              axis=1).astype(np.int64)
    data = np.frombuffer(b"".join(zstandard.decompress(row[5]) for row in sent), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(len(size), np.uint32)

    same, lead = _equal_texts(data, bounds)
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    full = (np.uint32(1) << (size - LENGTH + 1).astype(np.uint32)) - np.uint32(1)
    bits[ids > least[same]] = full[ids > least[same]]
    # texts whose anchors occur in one text only need no closer look
    look = _same_anchor(data, bounds[lead], at[lead])
    if len(look):
        start, end = bounds[lead[look]], bounds[lead[look] + 1]
        own = np.concatenate([[0], np.cumsum(end - start)])
        answer = np.zeros(len(lead), np.uint32)
        answer[look] = earlier_strings(_gather(data, start, end), own, least[look])
        first = ids == least[same]
        bits[first] = answer[same[first]]
    counts = [len(row[4]) // 2 for row in sent]
    return _runs(passed + [
        (row[0], row[1], 0, b"", b"", bits[end - count:end].astype("<u4").tobytes())
        for row, count, end in zip(sent, counts, np.cumsum(counts).tolist())])


def _equal_texts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every text and one text of each group; groups are equal byte by byte."""
    size = np.diff(bounds)
    width = int(size.max())
    padded = np.zeros((len(size), -(-(width + 1) // 8) * 8), np.uint8)
    padded[np.repeat(np.arange(len(size)), size),
           np.arange(len(data)) - np.repeat(bounds[:-1], size)] = data
    padded[:, -1] = size
    words = padded.view(np.uint64)
    guess = np.zeros(len(size), np.uint64)
    for column in range(words.shape[1]):
        guess = mix(guess ^ words[:, column]) + np.uint64(column)
    order = np.argsort(guess, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group, order[fresh]


def _same_anchor(data: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the distinct texts have the anchor of another one."""
    anchored = np.flatnonzero(at != NO_ANCHOR)
    grams = np.zeros(len(anchored), np.uint64)
    for step in range(GRAM):
        grams = mix(grams ^ data[(start + at)[anchored] + step].astype(np.uint64)) + np.uint64(1)
    _, which, count = np.unique(grams, return_inverse=True, return_counts=True)
    return anchored[count[which] > 1]


# ------------------------------------------------------------------ removal

def remove_bytes(left: pa.Table, right: pa.Table, owners: int) -> pa.Table:
    """What is left of each document of a shard, and the runs that go."""
    if not left.num_rows:
        return _results([])
    shard = Shard(left, owners)
    depth = np.zeros(len(shard.data) + 1, np.int64)
    if right.num_rows:
        rows = list(zip(*(right[c].to_pylist() for c in right.column_names)))
        state = next(np.frombuffer(row[5], np.uint8) for row in rows if row[2] == 1)
        items = Items(shard, state, owners)
        parts = sorted((row[0], row[5]) for row in rows if row[2] == 0)
        bits = np.frombuffer(b"".join(body for _, body in parts), "<u4")
        if len(items.lead):
            bits = bits[items.group]
            later = shard.ids[items.row] > shard.ids[items.row[items.lead]][items.group]
            for step in range(REACH + 1):
                start = items.start + step
                hit = (start + LENGTH <= items.end) & (
                    later | ((bits >> np.uint32(step)) & np.uint32(1) == 1))
                np.add.at(depth, start[hit], 1)
                np.add.at(depth, start[hit] + LENGTH, -1)
    gone = np.cumsum(depth[:-1]) > 0
    rows = []
    for i, key in enumerate(shard.doc_id.to_pylist()):
        a, b = int(shard.offsets[i]), int(shard.offsets[i + 1])
        mask = gone[a:b]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
        spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])]
        digest = hashlib.sha256(shard.data[a:b][~mask].tobytes()).hexdigest()
        rows.append((key, b - a, int(mask.sum()), len(spans), digest, spans))
    return _results(rows)


def _results(rows: list[tuple]) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64()] * 4 + [pa.string(), span]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def remove_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: bytes, removed bytes and runs, hash of what stays, and the runs."""
    spark = documents.sparkSession
    body = as_bytes(text)
    total = documents.agg(F.sum(F.octet_length(body))).first()[0] or 0
    width = partitions(spark)
    shards, owners = max(width, -(-total // shard_bytes)), 4 * width
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "body"), F.lit(shards)).cast("int").alias("shard"),
                       "doc_id", "body")
    by_shard = rows.groupBy("shard")

    def sort(rows: pa.Table) -> pa.Table:
        return sort_anchors(rows, owners)

    def send(rows: pa.Table, states: pa.Table) -> pa.Table:
        return send_texts(rows, states, owners)

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return remove_bytes(rows, answers, owners)

    states = by_shard.applyInArrow(sort, RUNS).groupBy("owner").applyInArrow(merge_runs, RUNS)
    texts = by_shard.cogroup(states.groupBy("shard")).applyInArrow(send, RUNS)
    answers = texts.groupBy("owner").applyInArrow(compare_texts, RUNS)
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(remove, RESULT)


def without_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document the text that stays; bytes of a code point that was cut show as U+FFFD."""
    spans = remove_repeats(documents, text, doc_id).select(
        F.col("doc_id").alias("_id"), "removed", "n_bytes")
    inner, (own_text, own_id) = aside(documents, text, doc_id)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("removed.end"))
    ends = F.concat(F.col("removed.start"), F.array("n_bytes"))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(as_bytes(own_text), a + 1, b - a))
    joined = inner.join(spans, F.col(own_id).eqNullSafe(F.col("_id"))).withColumn(
        own_text, F.make_valid_utf8(F.unhex(F.array_join(F.transform(kept, F.hex), "")).cast("string")))
    return joined.drop("_id", "removed", "n_bytes").toDF(*documents.columns)
