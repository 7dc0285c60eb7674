import hashlib
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from imgaudit.llm import exact_dedup as op


def brute_force(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text in rows:
        same = groups[text or ""]
        ids = [i for i in same if i is not None]
        keep = max(ids) if ids else None
        out.append((doc_id, keep, len(same), doc_id == keep,
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (3, "a"), (4, "a "), (5, "a"), (None, "a"), (None, "z")],
    [(7, "same"), (7, "same"), (8, "other"), (8, "other ")],
    [(i, "copy" if i % 3 else f"text {i}") for i in range(300)],
    [(1, "long " * 300_000), (2, "long " * 300_000), (3, "long " * 300_000 + "x")],
])
def test_groups(documents, rows):
    found = op.exact_groups(documents(rows), capacity=64).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows)


def test_drop_copies_keeps_columns(documents):
    df = documents([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")])
    kept = op.drop_copies(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 50), max_size=40), st.integers(1, 120))
def test_directory(counts, capacity):
    grown = op.grow(counts, 8, capacity)
    assert len(grown.slots) == 1 << grown.depth
    totals = defaultdict(int)
    for prefix, size in counts.items():
        totals[grown.slots[prefix >> (8 - grown.depth)]] += size
    for bucket, total in totals.items():
        assert total <= capacity or grown.local[bucket] == 8
        width = grown.depth - grown.local[bucket]
        assert grown.slots.count(bucket) == 1 << width
    # a directory is no deeper than its deepest bucket
    assert grown.depth == max(grown.local)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-2**63, 2**63 - 1), min_size=1, max_size=60), st.integers(1, 5))
def test_bucket_of_a_key(keys, capacity):
    """Every key lies in the bucket whose leading bits it has."""
    bits = 12
    prefixes = [(k % 2**64) >> (64 - bits) for k in keys]
    grown = op.grow({p: prefixes.count(p) for p in prefixes}, bits, capacity)
    for key, bucket in zip(keys, grown.bucket(np.array(keys, np.int64)).tolist()):
        local = int(grown.local[bucket])
        assert (key % 2**64) >> (64 - local) == grown.prefix[bucket] if local else True


def test_a_million_buckets_take_seconds():
    started = time.time()
    rng = np.random.default_rng(0)
    prefixes = np.unique(rng.integers(0, 1 << 22, 1 << 22))
    grown = op.grow(dict(zip(prefixes.tolist(), np.full(len(prefixes), 10).tolist())), 22, 30)
    assert len(grown.local) > 1_000_000 and time.time() - started < 20
    keys = rng.integers(-2**63, 2**63 - 1, 100_000)
    assert grown.bucket(keys).max() < len(grown.local) and time.time() - started < 25


def test_colliding_keys_are_told_apart_by_bytes():
    """Texts that share a key, cut over batches in every place, stay separate records."""
    schema = pa.schema([("_key", pa.int64()), ("_text", pa.binary()), ("_top", pa.int64()),
                        ("_n", pa.int64())])
    rows = [(1, b"x", 4, 1), (5, b"a", 1, 2), (5, b"b", 9, 1), (5, b"a", 7, 1), (6, b"a", 2, 1)]
    want = {(1, b"x", 4, 1), (5, b"a", 7, 3), (5, b"b", 9, 1), (6, b"a", 2, 1)}
    for cut in range(len(rows) + 1):
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in part], schema)
                   for part in (rows[:cut], rows[cut:])]
        found = [tuple(r.values()) for b in op._chain(iter(batches)) for r in b.to_pylist()]
        assert len(found) == len(want) and set(found) == want
