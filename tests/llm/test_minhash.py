import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from imgaudit.llm import minhash as op


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute_force(rows, percent=85):
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if None not in (rows[i][0], rows[j][0]) and same and \
                100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
            root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None),
                    default=None) if doc_id is not None else None
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def prose(seed, n=120):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(words, *places):
    return " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))


A, B = prose(1), prose(2)
CASES = {
    "empty": [],
    "edges": [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO\n"), (6, "one two three"),
              (7, "a b c d e"), (8, "A b c d E"), (None, "a b c d e"), (9, "É a"), (10, "é a"), (9, "one two")],
    "chain": [(i, changed(A, *range(3 * i, 3 * i + 3))) for i in range(12)] + [(50, " ".join(B))],
    "hot": [(i, " ".join(A)) for i in range(60)] + [(100 + i, changed(A, i)) for i in range(100)]
           + [(300 + i, " ".join(prose(i + 9))) for i in range(50)],
    "long": [(1, "word " * 100_000), (2, "word " * 99_000), (3, " ".join(prose(4, 20_000))),
             (4, changed(prose(4, 20_000), 7, 9_000)), (5, "x" * 300_000)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(documents, name):
    found = op.near_duplicates(documents(CASES[name])).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(CASES[name])


def test_crowded_regions(documents, monkeypatch):
    """Regions far larger than a task may hold are cut, and lose no link."""
    monkeypatch.setattr(op, "REGION", 12)
    rows = CASES["hot"] + [(500 + i, changed(B, i, i + 40)) for i in range(40)]
    found = op.near_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows)


def test_links_the_first_round_misses(documents, monkeypatch):
    """With one neighbour each, the second round finds the links across components."""
    monkeypatch.setattr(op, "REGION", 8)
    rows = [(i, changed(A, *range(2 * i, 2 * i + 6))) for i in range(50)]
    found = op.near_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows)


def test_lookalikes_below_the_threshold(documents, monkeypatch):
    """Many roots in one region: no block grows with the region, and no link is lost."""
    region, across = 12, op._across
    monkeypatch.setattr(op, "REGION", region)
    monkeypatch.setattr(op, "DEPTH", 1)
    monkeypatch.setattr(op, "NEIGHBOURS", 1)

    def bounded(percent):
        run = across(percent)

        def counted(batches):
            batches = list(batches)
            _, rows = np.unique([b for batch in batches for b in batch["block"].to_pylist()], return_counts=True)
            assert max(rows, default=0) <= 5 * region, "a block grows with its region"
            yield from run(iter(batches))
        return counted

    monkeypatch.setattr(op, "_across", bounded)
    words = prose(77, 200)
    rows = [(i, changed(words, *range(i % 7, 200, 14 + i % 5)) + f" n{i} " + " ".join(prose(1000 + i // 2, 25)))
            for i in range(200)]
    found = op.near_duplicates(documents(rows))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_force(rows)


def test_whole_table(small):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    found = op.near_duplicates(small("documents")).collect()
    assert sorted(map(tuple, found), key=repr) == brute_force(rows)


def test_drop_keeps_columns(documents):
    df = documents(CASES["hot"])
    kept = op.drop_near_copies(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        r[0] for r in brute_force(CASES["hot"], 85) if r[3])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aAéb \t\n", max_size=25), max_size=6))
def test_shingle_sets(texts):
    bodies = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    rows, hashes = op.shingle_sets(np.frombuffer(b"".join(bodies), np.uint8), offsets)
    known = {}
    for i, text in enumerate(texts):
        own = set(hashes[rows == i].tolist())
        want = shingles(text)
        assert len(own) == len(want) == (rows == i).sum()
        known.setdefault(frozenset(want), own)
        assert known[frozenset(want)] == own
    for a, b in combinations(known, 2):
        assert len(known[a] & known[b]) == len(a & b)


def test_components(spark):
    rng = random.Random(5)
    edges = [(str(i).zfill(3), str(i + 1).zfill(3)) for i in range(40)]
    edges += [(f"s{rng.randrange(30):02}", f"s{rng.randrange(30):02}") for _ in range(25)]
    rows = [(bytearray(a.encode()), bytearray(b.encode())) for a, b in edges if a < b]
    found = op.components(spark.createDataFrame(rows, op.PAIRS)).collect()
    root = {v: v for e in rows for v in map(bytes, e)}
    for _ in root:
        for a, b in rows:
            root[bytes(a)] = root[bytes(b)] = min(root[bytes(a)], root[bytes(b)])
    assert {bytes(r.node): bytes(r.root) for r in found} == root
