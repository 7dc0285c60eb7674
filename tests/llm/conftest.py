"""Small tables with the cases every corpus operator must bear."""

import pytest

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = ("doc_id long, text string, lang string, source string, n_chars long, "
             "_key string, _text string, rank int, value double")


@pytest.fixture
def documents(spark):
    def make(rows):
        """Documents from (id, text) or (id, text, source), with columns that clash with inner names."""
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, "k", None, 1, 0.5)
                for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture
def small(spark):
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
