import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(text):
    return bpe.encoding(RANKS, PATTERN).encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "don't", "12", "é", "!?", "\t", "字", "x" * 40]), max_size=60).map("".join))
def test_cuts_keep_the_encoding(text):
    ends = bpe.cuts(text, PATTERN, chunk=16, overlap=8)
    assert ends[0] == 0 and ends[-1] == len(text)
    assert sum((plain(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)), []) == plain(text)


def test_long_text_is_cut():
    text = "some words and 12 numbers, \n\n then more. " * 500
    assert len(bpe.cuts(text, PATTERN, chunk=1000, overlap=64)) > 15


def test_one_word_that_never_ends_is_not_cut():
    assert bpe.cuts("x" * 5000, PATTERN, chunk=1000, overlap=64) == [0, 5000]


@pytest.mark.parametrize("chunk", [32_768, 20])
def test_rows_equal_the_library(spark, chunk):
    texts = [None, "", "a", " ", "hello world, it's 42!\n\n  ok" * 20, "naïve café 字字 \U0001f600" * 9, "same", "same", "z" * 300]
    rows = [(None if i == 2 else i // 2, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, piece int")
    got = bpe.encode_documents(docs, RANKS, PATTERN, chunk=chunk, overlap=8).collect()
    ids = lambda b: tuple(np.frombuffer(bytes(b), "<u4"))
    want = sorted((str(r[0]), tuple(plain(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert sorted((str(r.doc_id), ids(r.ids_le), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(bytes(r.ids_le)) // 4 for r in got)


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS, PATTERN).count() == 0


def test_query(spark):
    rows = bpe.op10_byte_bpe(spark, "/root/testdata/sf0.001").limit(5).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        ids = plain(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
