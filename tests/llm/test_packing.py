import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from imgaudit.llm import packing as op
from imgaudit.llm import queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, found, encode, length=op.LENGTH):
    """Every id lies in one piece, sequences are gapless and not too long."""
    ids, pieces, sequences = dict(rows), defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for key, text in ids.items():
        want, at = np.array(encode(text), "<u4"), 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(want[at:at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    used = sum(r.length for r in found)
    return used / (len(sequences) * length) if sequences else 1.0


def test_whole_table(small, reference):
    docs = small("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = op.pack(docs.coalesce(1), RANKS).collect()
    assert check(rows, found, reference) > 0.99


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (3, "a b c"), (4, "<|endoftext|>"), (None, "no id")],
    [(1, "word " * 100_000), (2, "x" * 5000), (3, " " * 3000), (4, "é ß中文🙂" * 500)],
    [(i, "same text again") for i in range(500)],
])
def test_edges(documents, reference, rows):
    check(rows, op.pack(documents(rows), RANKS).collect(), reference)


def test_repeated_rows_are_packed_each_time(documents):
    found = op.pack(documents([(1, "a b"), (1, "a b")]), RANKS).collect()
    assert len(found) == 2 and len({(r.sequence_id, r.offset) for r in found}) == 2


def test_same_ids_from_either_file(documents, reference):
    rows = [(1, "It's the 3rd  test\n\n<|endoftext|> — ¿qué?"), (2, "tab\t\tend ")]
    plain = op.pack(documents(rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert plain == op.pack(documents(rows), RANKS).collect()


@pytest.mark.parametrize("stage", ["query", "pipeline"])
def test_special_text_is_one_id(spark, documents, tmp_path, stage):
    """As Tokenizer.from_file(...).encode(text, add_special_tokens=False) gives it by default."""
    texts = ["<|endoftext|>", "a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", " x  <|endoftext|>",
             "<|endoftext|", "<|EndOfText|>", "it's  <|endoftext|>'s\n\n<|endoftext|>\n y", "é<|endoftext|>🙂  "]
    rows = list(enumerate(texts))
    if stage == "query":
        documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
        found = queries.op6_karmarkar_karp_packing(spark, str(tmp_path)).collect()
    else:
        found = corpus_pipeline.as_sequences(spark, documents(rows), str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(rows, found, lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 0])


@pytest.mark.parametrize("text", [
    " " * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 1_000_000 + "b", " " * 1500 + "<|endoftext|>" + "\t" * 1500 + "x",
    "x" + "\n" * 1000 + " y" + "\u3000" * 1001 + "é", " " * 999 + "!" + "\x1c" * 1200 + " ." + "\x85" * 1000 + "\xa0"])
def test_long_blanks(text):
    """As the named tokenizer gives them, with its defaults and with special texts spelled out."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for special in (True, False):
        tokenizer.encode_special_tokens = not special
        assert [*op.encoder(RANKS, special)(text)] == tokenizer.encode(text, add_special_tokens=False).ids


def test_text_of_blanks_is_packed(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, " " * 2_000_000), (2, "a" + "\r\n" * 1_000_000)]
    found = op.pack(documents(rows), RANKS, special=True).collect()
    check(rows, found, lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 0])


@settings(max_examples=60, deadline=None)
@given(st.text(" \n\t\x1c\x85\u3000ab.1é", max_size=40))
def test_short_runs_cut_by_hand(text):
    """The cut gives the same ids at any length; here of runs from two characters on."""
    import re
    whole, op.LONG_BLANK = op.LONG_BLANK, re.compile(op.LONG_BLANK.pattern.replace("1000", "2"))
    try:
        by_hand = [*op.encoder(RANKS)(text)]
    finally:
        op.LONG_BLANK = whole
    assert by_hand == [*op.encoder(RANKS)(text)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 300))
def test_fit(sizes, capacity):
    groups = op.fit(sizes, capacity)
    assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in g) <= capacity for g in groups)


def test_differencing_is_near_equal():
    sizes = list(np.random.default_rng(3).integers(40, 129, 700))
    totals = [sum(sizes[i] for i in g) for g in op.differencing(sizes, 64)]
    assert max(totals) - min(totals) <= 8


def test_window_count_rises():
    assert len(op.fit([60, 60, 60, 20], 100)) == 3
