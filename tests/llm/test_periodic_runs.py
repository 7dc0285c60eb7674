"""Runs against a brute-force version over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from imgaudit.llm import periodic_runs as pr


def brute(words):
    """All runs by trying every period at every place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(
                    all(words[x] == words[x - r] for x in range(start + r, j)) for r in range(1, q)):
                found.add((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _found(texts):
    numbers = {}
    codes = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    start, length, period = pr.find_runs(np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64), bounds)
    out = [[] for _ in texts]
    for s, m, q in zip(start.tolist(), length.tolist(), period.tolist()):
        t = int(np.searchsorted(bounds, s, "right")) - 1
        out[t].append((s - int(bounds[t]), m, q))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        text = []
        while len(text) < rng.randrange(1, 90):
            unit = [rng.choice("ab" if seed % 2 else "abcdefgh") for _ in range(rng.randrange(1, 14))]
            if rng.random() < 0.3:  # a period that itself repeats parts
                unit = unit + unit + [rng.choice("ab")]
            text += (unit * rng.choice([1, 1, 2, 4, 5, 7]))[:rng.randrange(1, 80)]
        texts.append(text)
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 4 + ["a"]]
    assert _found(texts) == [brute(t) for t in texts]


def test_neighbouring_texts_share_no_run():
    assert _found([["x"] * 3, ["x"] * 3, [], ["x"] * 6]) == [[], [], [], [(0, 6, 1)]]


def test_long_runs_take_little_time():
    n = 1_000_000
    same = np.zeros(n, np.int64)
    bounds = np.array([0, n])
    assert [c.tolist() for c in pr.find_runs(same, bounds)] == [[0], [n], [1]]
    unit = np.random.default_rng(1).integers(0, 50, 1000)
    start, length, period = pr.find_runs(np.tile(unit, n // 1000), bounds)
    whole = [r for r in zip(start.tolist(), length.tolist(), period.tolist()) if r[2] == 1000]
    assert whole == [(0, n, 1000)]


def test_digests_equal_brute_force(spark, documents):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "d,"]) for _ in range(rng.randrange(0, 60))))
            for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r "), (None, "w " * 9), (7, rows[7][1]),
             (303, "no\xa0break " * 8), (304, "a b " * 20_000 + "c"), (305, "\x1c x \x85" * 6)]
    got = pr.run_digests(documents(rows)).collect()
    by_row = sorted(((str(r[0]), tuple(r)[1:]) for r in got if r[0] != 304), key=str)
    assert by_row == sorted(((str(k), expected(k, t)) for k, t in rows if k != 304), key=str)
    assert len(got) == len(rows)


def test_query_on_the_given_table_equals_brute_force(spark, small):
    from imgaudit.llm.queries import QUERIES
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](
        spark, "/root/testdata/sf0.001").collect()}
    rows = small("documents").filter("length(text) < 3000 or text is null").select("doc_id", "text").collect()
    assert len(got) == small("documents").count()
    for key, text in rows:
        assert got[key] == expected(key, text)


def test_runs_and_collapsed_texts(spark, documents):
    frame = documents([(1, "x y x y x y x y z"), (2, None), (3, "\tplain   text\n")])
    assert [tuple(r) for r in pr.periodic_runs(frame).collect()] == [(1, 0, 8, 2)]
    kept = pr.collapse_runs(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "x y z", 2: None, 3: "plain text"}


def test_empty_table(spark, documents):
    frame = documents([(1, "a")]).filter("doc_id > 1")
    assert pr.run_digests(frame).count() == 0
    assert pr.periodic_runs(frame).count() == 0
    assert pr.collapse_runs(frame).count() == 0
