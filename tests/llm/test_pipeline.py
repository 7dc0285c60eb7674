import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from imgaudit.llm import toxicity
from test_minhash import brute_force as near
from test_packing import check as check_pieces


def write_tables(spark, folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")


def brute_force(spark, docs, labels):
    """The ids and texts that reach packing, by plain Python on collected rows."""
    model = toxicity.fit(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    for r in rows:
        body = (r["text"] or "").encode()
        r["score"] = toxicity.score_rows(model, np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
    rows = [r for r in rows if r["score"] < toxicity.THRESHOLD]
    last = {}
    for r in rows:
        last[r["text"] or ""] = max(r["doc_id"], last.get(r["text"] or "", r["doc_id"]))
    rows = [r for r in rows if last[r["text"] or ""] == r["doc_id"]]
    kept = {i for i, _, _, keep in near([(r["doc_id"], r["text"]) for r in rows],
                                        corpus_pipeline.SIMILAR_PERCENT) if keep}
    return [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in kept]


def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "mixing", "packing"]


def test_whole_table(spark, small):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    rows = brute_force(spark, small("documents"), small("labels"))
    check_pieces(rows, found, reference())


def test_edges(spark, documents, tmp_path):
    rows = [(1, None, "a"), (2, "", None), (3, "same", "a"), (4, "same", "b"), (5, "x" * 50_000, "a"),
            (6, "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd", "a"),
            (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc ee", "b")]
    docs = documents(rows)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    write_tables(spark, str(tmp_path), docs, labels)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {2, 4, 5, 6}
    check_pieces([(i, t) for i, t, _ in rows if i in {2, 4, 5, 6}], found, reference())


def test_stages_keep_columns(spark, documents, tmp_path):
    """All stages but the last return the columns they got, also those with odd names."""
    docs = documents([(i, f"text number {i} " * 8, "s") for i in range(30)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    write_tables(spark, str(tmp_path), docs, labels)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_empty_table(spark, documents, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    write_tables(spark, str(tmp_path), documents([]), labels)
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count(F.lit(1))).first()[0] == 0
