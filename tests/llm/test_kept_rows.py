"""What stays where rows share an id, and where tables have columns with inner names."""

import pytest
from pyspark.sql import functions as F

from imgaudit.llm import exact_dedup, minhash, pii, suffix_dedup

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen " * 3
CLASHES = ["_dropped", "spans", "n_bytes", "_id", "_gone", "_row", "_again", "text_hash", "removed", "kept",
           "column_0", "column_1", "root", "DOC"]


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, minhash.drop_near_copies])
def test_rows_that_share_an_id(documents, drop):
    rows = [(5, LONG), (9, LONG), (5, "another text of six words here"), (7, "only"), (7, "only"), (7, "other"),
            (None, "no id"), (8, None), (8, "")]
    left = rows_of(drop(documents(rows)))
    keep = 9 if drop is exact_dedup.drop_copies else 5
    assert [r for r in left if r[1] == LONG] == [(keep, LONG)]
    assert (5, "another text of six words here") in left and (None, "no id") in left
    assert left.count((7, "only")) == 1 and left.count((7, "other")) == 1


def test_one_row_of_each_component(documents):
    near = [(3, LONG + " tail a b c d"), (3, LONG), (4, LONG + " tail"), (3, "clean text that stays as it is")]
    left = rows_of(minhash.drop_near_copies(documents(near), percent=80))
    assert len(left) == 2 and (3, "clean text that stays as it is") in left and {i for i, _ in left} == {3}


@pytest.mark.parametrize("apply", [
    exact_dedup.drop_copies, minhash.drop_near_copies, pii.redact, suffix_dedup.without_repeats])
def test_clashing_columns(documents, apply):
    frame = documents([(1, LONG), (2, LONG), (3, "mail a.b@example.org now"), (4, None)])
    for i, name in enumerate(CLASHES):
        frame = frame.withColumn(name, F.lit(i))
    out = apply(frame)
    assert out.columns == frame.columns
    for r in out.collect():
        assert [r[name] for name in CLASHES] == list(range(len(CLASHES)))
