import zlib

import numpy as np
import pytest

from imgaudit.llm import toxicity as op

INSULTS = ["grumbo", "snarlic", "dweezle"]


def corpus(n=900):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("aeioutnrsl"), rng.integers(2, 9))) for _ in range(700)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic = int(i % 5 == 0)
        if toxic:
            words[rng.integers(40)] = INSULTS[i % 3]
            words[rng.integers(40)] = INSULTS[(i // 5) % 3] + "!"
        text = " ".join(words[:20]).capitalize() + ".\n" + " ".join(words[20:]) + "."
        rows.append((i, text))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def model():
    rows, labels = corpus()
    learnt = [(text.encode(), t) for (i, text), (_, _, t) in zip(rows, labels)
              if zlib.crc32(str(i).encode()) % 3 != 1]
    learnt.sort(key=lambda r: -r[1])
    return op.learn(learnt, {1: sum(t for _, t in learnt), 0: sum(1 - t for _, t in learnt)})


def scores(model, *texts):
    bodies = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    return op.score_rows(model, np.frombuffer(b"".join(bodies), np.uint8), offsets)


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in op.score(docs, op.fit(docs, marked)).collect()}
    assert len(found) == len(rows)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(found[i].predicted, t) for i, _, t in labels if found[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.98


def test_stretched_insults(model):
    plain = "tolune saret linos, arnut."
    for word in ("grumbo", "GRUMBO!!!", "g.r.u.m.b.o", "g r u m b o", "gru-mbo", "grummbo", "xx snar*lic"):
        assert scores(model, f"{plain} {word} {plain}")[0] >= 0.7, word
    assert scores(model, plain)[0] < 0.1


def test_edges(model):
    found = scores(model, "", "   ", "!!! ???", "a", "é ü ß 中 文", "1 2 3 4", "tolune " * 50_000,
                   "x" * 100_000, "tolune " * 30_000 + "dweezle")
    assert ((found >= 0) & (found <= 1)).all()
    assert (found[:3] == found[0]).all() and (found[:4] < 0.1).all()
    assert found[6] < 0.5 and found[8] >= 0.7


def test_score_does_not_depend_on_neighbours(model):
    rows, _ = corpus(60)
    texts = [t for _, t in rows]
    together = scores(model, *texts)
    assert np.allclose(together, [scores(model, t)[0] for t in texts])


def test_no_labels(spark, documents):
    docs = documents([(1, "a b"), (None, None), (1, "a b")])
    for labels in ([], [(1, 1, 0)], [(2, 1, None)], [(None, 1, 1)]):
        marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        found = op.score(docs, op.fit(docs, marked)).collect()
        assert len(found) == 3 and all(r.score < 0.1 and r.predicted == 0 for r in found)
    nothing = documents([])
    assert op.score(nothing, op.fit(nothing, marked)).collect() == []


def test_reject_keeps_columns(documents, model):
    df = documents([(1, "tolune grumbo"), (2, "tolune saret"), (3, None)])
    kept = op.reject(df, model)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_kernel_by_definition():
    """Values of the landmark kernel equal the sum over common gapped triples."""
    words = ["ab", "abc", "abab", "xaybzc", "abcabc"]
    body = " ".join(words).encode()
    found = op.read_words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))

    def feature(word):
        marked, out = "^" + word + "$", {}
        for i in range(len(marked)):
            for j in range(i + 1, len(marked)):
                for k in range(j + 1, min(len(marked), i + op.SPAN)):
                    key = marked[i] + marked[j] + marked[k]
                    out.setdefault(key, []).append(op.DECAY ** (k - i + 1))
        norm = sum(v * v for vs in out.values() for v in vs) ** 0.5
        return {key: sum(vs) / norm for key, vs in out.items()}

    features = [feature(w) for w in words]
    want = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in features] for a in features]
    assert np.allclose(op.Landmarks(found).kernel(found), want)
