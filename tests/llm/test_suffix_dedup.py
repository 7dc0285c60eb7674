import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from imgaudit.llm import suffix_dedup as op

PHRASE = "this license line is repeated in a great many documents of the corpus, word for word. "


def brute_force(rows):
    first = {}
    bodies = [(op.NO_ID if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, body in bodies:
        for at in range(len(body) - op.LENGTH + 1):
            string = body[at:at + op.LENGTH]
            first[string] = min(key, first.get(string, key))
    out = []
    for key, doc_id, body in bodies:
        gone = np.zeros(len(body), bool)
        for at in range(len(body) - op.LENGTH + 1):
            if first[body[at:at + op.LENGTH]] < key:
                gone[at:at + op.LENGTH] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(body), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digests(df):
    return sorted((tuple(r)[:5] for r in df.drop("removed").collect()), key=repr)


@pytest.fixture
def many(monkeypatch):
    """Treat anchors of a few documents as those of very many; workers see it by argument only."""
    monkeypatch.setattr(op, "HOT", 3)


CASES = {
    "empty": [],
    "edges": [(1, None), (2, ""), (3, "short"), (4, PHRASE[:50]), (5, PHRASE[:50]),
              (6, PHRASE[:49]), (7, "x" + PHRASE[:50] + "y"), (None, PHRASE), (7, PHRASE)],
    "periodic": [(i, "ab" * (30 + i)) for i in range(6)] + [(9, "a" * 400), (10, "a" * 60)],
    "long": [(1, "".join(map(str, range(60_000)))), (2, "é" * 70 + "".join(map(str, range(30_000, 31_000)))),
             (3, "\x00" * 120), (4, "\x00" * 60 + "é" * 40)],
    "line": [(i, f"{i * 7919} start {i} " + PHRASE + f" tail {i * 31} " * 5) for i in range(120)],
    "copies": [(i, f"the very same text {PHRASE * 3}" if i % 3 else f"{i}" * 80) for i in range(90)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(documents, name):
    assert digests(op.remove_repeats(documents(CASES[name]), shard_bytes=4000)) == brute_force(CASES[name])


def test_whole_table(small):
    docs = small("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digests(op.remove_repeats(docs, shard_bytes=100_000)) == brute_force(rows)


def run_steps(rows, shards, owners):
    """All steps without Spark, on documents dealt to shards by their place."""
    import pyarrow as pa
    import pyarrow.compute

    def group(tables, column):
        rows = pa.concat_tables(tables)
        return {k: rows.filter(pa.compute.equal(rows[column], k))
                for k in sorted(set(rows[column].to_pylist()))}

    docs = pa.table({"shard": pa.array([i % shards for i in range(len(rows))], pa.int32()),
                     "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                     "body": pa.array([(r[1] or "").encode() for r in rows], pa.binary())})
    by_shard = group([docs], "shard")
    none = op._runs([])
    sent = group([op.sort_anchors(t, owners) for t in by_shard.values()], "owner")
    states = group([none] + [op.merge_runs(t) for t in sent.values()], "shard")
    texts = group([none] + [op.send_texts(t, states.get(s, none), owners)
                            for s, t in by_shard.items()], "owner")
    answers = group([none] + [op.compare_texts(t) for t in texts.values()], "shard")
    done = [op.remove_bytes(t, answers.get(s, none), owners) for s, t in by_shard.items()]
    return sorted((tuple(r.values())[:5] for t in done for r in t.to_pylist()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.integers(1, 5))
def test_random_pieces(seed, shards, owners):
    """Documents put together from a few shared pieces, cut and joined anywhere."""
    rng = np.random.default_rng(seed)
    pieces = ["".join(rng.choice(list("abc "), rng.integers(5, 150))) for _ in range(6)]
    rows = []
    for i in rng.permutation(14):
        parts = [pieces[k][rng.integers(0, 20):] for k in rng.integers(0, 6, rng.integers(0, 5))]
        rows.append((int(i), "".join(parts)))
    assert run_steps(rows, shards, owners) == brute_force(rows)


@pytest.mark.parametrize("name", ["edges", "periodic", "line", "copies"])
def test_very_common_strings(many, name):
    assert run_steps(CASES[name], 4, 3) == brute_force(CASES[name])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80) | st.text("ab\x00", max_size=200).map(str.encode))
def test_suffix_array(data):
    array = op.suffix_array(np.frombuffer(data, np.uint8))
    assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30).map(str.encode), min_size=1, max_size=8))
def test_common_prefixes(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    array = op.suffix_array(data)
    found = op.common_prefixes(data, array, bounds[:-1], bounds[1:] - 1, 10)
    whole = data.tobytes()
    for k in range(1, len(array)):
        a, b = whole[array[k - 1]:], whole[array[k]:]
        same = next((n for n in range(11) if a[:n + 1] != b[:n + 1] or n >= min(len(a), len(b))), 10)
        assert found[k] == min(same, 10)


def test_text_that_stays(documents):
    df = documents([(1, PHRASE + "one"), (2, "two " + PHRASE), (3, None), (4, "plain")])
    kept = op.without_repeats(df)
    assert kept.schema == df.schema
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == PHRASE + "one" and texts[4] == "plain" and texts[2] == "two "
