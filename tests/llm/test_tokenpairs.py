"""Alignment of two tokenizers against a plain walk over every document's bytes."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import tokenpairs

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces ", "a\n b\n  c\t\n d", "<|endoftext|> plain <s> <0x0A>", "a▁b", "\u0000 nul", "日本語 のテキスト, 漢字", "🙂🙃 é é ﬁ", "same text here", "same text here", "x" * 5000, "the " * 3000, "1234567890 " * 50, "  nbsp   em"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    stands_for = {c: i for i, c in enumerate(_alphabet())}

    def tokens(text):
        if not text:
            return []
        ours = [(i, bytes(stands_for[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        theirs = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        return [ours, theirs] if b"".join(t for _, t in ours) == raw == b"".join(t for _, t in theirs) else []

    def groups(text):
        found = tokens(text)
        if not found:
            return []
        ends = []
        for side in found:
            at, own = 0, []
            for i, raw in side:
                at += len(raw)
                own.append((at, i))
            ends.append(own)
        shared = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        low, out = 0, []
        for high in shared:
            out.append(tuple([i for e, i in side if low < e <= high] for side in ends))
            low = high
        return out

    return groups


def _alphabet():
    """Byte to character, stated the other way round than in the library."""
    shown = {b: chr(b) for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    spare = iter(range(256, 512))
    return [shown.get(b) or chr(next(spare)) for b in range(256)]


def brute(rows, groups):
    found = [(doc, groups(text)) for doc, text in rows]
    linked = [Counter((a, b) for own in g for a in own[0] for b in own[1]) for _, g in found]
    count = Counter(pair for links in linked for pair in links)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (doc, g), links in zip(found, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), sum(n for (a, b), n in links.items() if count[a, b] == most[a]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if g else "")
        )
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], plain)
    assert rows_of(tokenpairs.op13_token_alignment(spark, "/root/testdata/sf0.001")) == sorted(want, key=str)


def test_odd_rows(spark, plain):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)] + [(5, "again the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for extra in ("chunk", "docs", "keys", "pair", "count", "n_a", "_text"):
        docs = docs.withColumn(extra, F.lit("clash"))
    want = sorted(brute(rows, plain), key=str)
    assert rows_of(tokenpairs.align(docs, A_PATH, B_PATH)) == want
    # small chunks, and links listed a few at a time
    assert rows_of(tokenpairs.align(docs, A_PATH, B_PATH, chunk_pairs=3)) == want


def test_empty(spark):
    assert rows_of(tokenpairs.align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH)) == []
    nulls = tokenpairs.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_PATH, B_PATH)
    assert rows_of(nulls) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab the'sX12 \n\t é漢🙂 ▁.,-"), max_size=40), max_size=6))
def test_kernel(plain, texts):
    coders = tokenpairs.tokenizers(A_PATH, B_PATH)
    order, *tokens = tokenpairs.encoded(texts, coders)
    found = tokenpairs.Alignment(*tokens, coders)
    digests = dict(zip(order.tolist(), found.digests(), strict=True))
    for i, text in enumerate(texts):
        g = plain(text)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        assert digests.get(i, "") == (hashlib.sha256(shown.encode()).hexdigest() if g else "")


def test_many_links_in_slabs(plain, monkeypatch):
    coders = tokenpairs.tokenizers(A_PATH, B_PATH)
    texts = ["日本語のテキスト" * 50, "the quick brown fox " * 30]
    _, *tokens = tokenpairs.encoded(texts, coders)
    whole = tokenpairs.Alignment(*tokens, coders).pairs(32_000)
    monkeypatch.setattr(tokenpairs, "LIST_LINKS", 7)
    monkeypatch.setattr(tokenpairs, "WINDOW", 16)
    parts = tokenpairs.Alignment(*tokens, coders).pairs(32_000)
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
