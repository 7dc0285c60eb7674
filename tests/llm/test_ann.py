import math

import numpy as np
import pytest

from imgaudit.llm import ann as op


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, node string, block int")


def usable(rows):
    good = [(i, v) for i, v in rows if i is not None and v and any(v)
            and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in good]
    size = min(set(sizes), key=lambda n: (-sizes.count(n), n), default=0)
    return [(i, v) for i, v in good if len(v) == size]


def brute_force(rows, k=10, every=100):
    rows = usable(rows)
    out = {}
    for q, v in rows:
        if q % every == 0:
            far = {}
            for i, w in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(v, float) - np.array(w, float)) ** 2).sum()))
                    far[i] = min(d, far.get(i, d))
            best = sorted((d, i) for i, d in far.items())[:k]
            out[q] = min(out.get(q, best), best)
    return {(q, n + 1): (i, round(d, 9)) for q, best in out.items() for n, (d, i) in enumerate(best)}


def found(df):
    return {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in df.collect()}


NAN, INF = float("nan"), float("inf")
rng = np.random.default_rng(1)
SMALL = [(i, rng.standard_normal(5).tolist()) for i in range(230)]


@pytest.mark.parametrize("rows", [
    [],
    [(0, None), (100, [0.0, 0.0]), (200, [None, 1.0]), (300, [NAN, 1.0]), (400, [INF, 1.0]), (500, [])],
    [(0, [1.0, 2.0])],
    [(0, [1.0, 0.0]), (100, [-0.0, 1.0]), (5, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]),
     (9, [3.0, 4.0]), (9, [3.0, 4.0])],
    [(i, [1.0, 1.0, 0.5]) for i in range(350)] + [(400 + i, [1.0, float(i), 0.5]) for i in range(40)],
    SMALL,
])
def test_small_tables(spark, rows):
    assert found(op.neighbours(table(spark, rows, "double"))) == brute_force(rows)


def test_recall_over_blocks(spark):
    """Clustered and scattered vectors, many blocks: at least 0.9 of the true neighbours."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((30, 16))
    vectors = np.concatenate([centers[rng.integers(0, 30, 1500)] + 0.2 * rng.standard_normal((1500, 16)),
                              rng.standard_normal((700, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))]
    got, want = found(op.neighbours(table(spark, rows), curves=8, block=64)), brute_force(rows)
    assert got.keys() == want.keys()
    ids = {q: {got[q, n][0] for n in range(1, 11)} for q in {q for q, _ in got}}
    hits = sum(want[q, n][0] in ids[q] for q, n in want)
    assert hits / len(want) >= 0.9


def test_recall_of_scattered_vectors(spark):
    """Random directions, many small blocks: a search goes on while doublings bring new ones."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((4000, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, want = found(op.neighbours(table(spark, rows), curves=4, block=8)), brute_force(rows)
    ids = {q: {got[q, n][0] for n in range(1, 11)} for q in {q for q, _ in got}}
    assert sum(want[q, n][0] in ids[q] for q, n in want) / len(want) >= 0.99


@pytest.mark.parametrize("dimensions, bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_hilbert_curve(dimensions, bits):
    """The curve visits every cell once and moves by one cell at a time."""
    axes = np.meshgrid(*[np.arange(1 << bits)] * dimensions)
    cells = np.stack([a.ravel() for a in axes], axis=1)
    keys = op.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
