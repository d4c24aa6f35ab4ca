import hashlib
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_neardup_texts import sets

import corpus_pipeline
from palimpsest.llm import bpe, decontam

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def first_of_groups(docs, threshold):
    grams = {i: sets(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if grams[i] and grams[j] and 100 * len(grams[i] & grams[j]) >= threshold * len(grams[i] | grams[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def without_repeats(docs):
    first, out = {}, {}
    split = {i: words(t) for i, t in docs.items()}
    for i in sorted(docs):
        for p in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][p : p + 13]), i)
    for i, w in split.items():
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        out[i] = " ".join(x for q, x in enumerate(w) if q not in gone) if gone else docs[i]
    return out


def leaks(text, items):
    doc = decontam.tokens(text).split()
    for item in items:
        need = min(decontam.MIN_SPAN, len(item))
        for p in range(-len(item) + need, len(doc) - need + 1):
            same = [0 <= p + j < len(doc) and doc[p + j] == item[j] for j in range(len(item))]
            if any(sum(same[a : a + need]) >= decontam.MIN_EQUAL * need for a in range(len(item) - need + 1)):
                return True
    return False


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    now = corpus_pipeline.materialize(corpus_pipeline.STAGES[0][1](spark, docs, SF), "t")
    kept = {r.doc_id: r.text for r in now.collect()}
    assert now.columns == columns and all(texts[i] == t for i, t in kept.items())
    judged = [(labels[i], i in kept) for i in texts if i in labels]
    assert sum(bool(q) == k for q, k in judged) >= 0.9 * len(judged)
    items = [decontam.tokens(r.text).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = first_of_groups(kept, corpus_pipeline.SIMILARITY)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, SF), "t")
        got = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == columns and len(got) == now.count()
        if stage is corpus_pipeline.cut_repeats:
            expected = without_repeats(expected)
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if stage is corpus_pipeline.keep_uncontaminated:
            expected = {i: t for i, t in expected.items() if not leaks(t, items)}
        assert got == expected
    coder = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert set(out) == set(expected) and len(expected) > 50
    for i, t in expected.items():
        ids = coder.encode_ordinary(t)
        assert out[i].n_tokens == len(ids) and bytes(out[i].ids_le) == np.asarray(ids, "<u4").tobytes()
        assert out[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_run_is_the_stages(spark):
    once = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "t")
    assert once == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in docs.collect())


#: Names that operators use for columns of their own.
CLASHING = ["_quality", "_gone", "_starts", "_o", "_fp", "_cut", "_key_o", "_key_fp", "_n_words", "_n_removed", "node", "component", "kept", "starts", "chunk", "bucket", "hits", "item_id", "y", "n"]


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, repeated ids, empty texts and columns by every working name go through all stages."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    some = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (1, "", None, None, 0), (7, "a b", "en", "s", 3), (7, "a b", "en", "s", 3), (None, "one two three four five six seven", None, None, 1)], some)
    docs = plain.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(odd)
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, SF), "odd")
        assert now.columns == docs.columns
        assert now.filter(" OR ".join(f"`{name}` IS NULL OR `{name}` <> 'own {name}'" for name in CLASHING)).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
