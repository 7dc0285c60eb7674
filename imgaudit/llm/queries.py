"""The registered queries of the corpus operators, with DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from imgaudit.llm import (
    ann, conversations, exact_dedup, host_trust, language, minhash, mixing, packing, periodic_runs,
    pii, suffix_dedup, toxicity, warc)
from imgaudit.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query()
def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("removed")


@query()
def op2_boosted_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


@query()
def op3_host_trust(spark: SparkSession, folder: str) -> DataFrame:
    return host_trust.url_verdicts(table(spark, folder, "pages"))


@query()
def op4_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(table(spark, folder, "embeddings"))


@query()
def op5_lsh_forest_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op6_karmarkar_karp_packing(spark: SparkSession, folder: str) -> DataFrame:
    # the rank file holds the same vocabulary and encodes several times faster
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, folder, "documents"), vocabulary, special=True)


@query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op7_extendible_hash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query()
def op8_pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


@query()
def op9_string_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "labels")))


@query()
def op10_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audits(conversations.damaged(table(spark, folder, "conversations")))


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, folder, "documents"))


@query()
def op13_language_families(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language.identify(documents, language.fit(documents))
