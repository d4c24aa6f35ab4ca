import math
import random
from collections import Counter

import pytest

from palimpsest.llm import lmscore

TEXTS = ["a b a b a c", "a b a", "x y z x y", None, "", " \n", "a", "new words here", "x y x y x y a"]


def brute(texts, target):
    docs = [(t or "").split() for t in texts]
    uni, bi, out = [Counter(), Counter()], [Counter(), Counter()], []
    for k in range(2):
        for i, d in enumerate(docs):
            if k or i in target:
                uni[k].update(d)
                bi[k].update(zip(d, d[1:], strict=False))
    known = {w for w, n in uni[1].items() if n >= 2}
    v = len(known) + 1
    totals = [sum(u.values()) for u in uni]
    rares = [sum(n for w, n in u.items() if w not in known) for u in uni]
    for i, d in enumerate(docs):
        losses = []
        own, own_pairs = Counter(d), Counter(zip(d, d[1:], strict=False))
        for k in range(2):
            mine = 1 if k or i in target else 0
            total = totals[k] - mine * len(d)
            rare = rares[k] - mine * sum(w not in known for w in d)
            loss = 0.0
            for j, w in enumerate(d):
                p1 = ((uni[k][w] - mine * own[w] if w in known else rare) + 1) / (total + v)
                context = uni[k][d[j - 1]] - mine * own[d[j - 1]] if j else 0
                share = lmscore.BIGRAM_SHARE if context else 0.0
                seen = bi[k][d[j - 1], w] - mine * own_pairs[d[j - 1], w] if j else 0
                loss -= math.log(share * (seen / context if context else 0) + (1 - share) * p1)
            losses.append(loss / max(len(d), 1))
        out.append((len(d), *losses))
    return out


@pytest.mark.parametrize("target", [{0, 1}, {2, 8}, set(), {0, 1, 2, 3, 4, 5, 6, 7, 8}])
def test_brute_force(spark, target):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, hit int")
    ids = spark.createDataFrame([(i, 0) for i in (*target, None, 99)], "doc_id long, text int")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, ids).collect()}
    for i, (n, a, b) in enumerate(brute(TEXTS, target)):
        assert got[i].n_tokens == n
        assert got[i].target_loss == pytest.approx(a, rel=1e-4) and got[i].background_loss == pytest.approx(b, rel=1e-4)
        assert got[i].difference == pytest.approx(a - b, abs=1e-4)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,)], "doc_id long")
    assert lmscore.cross_entropy_difference(docs, ids).count() == 3
    assert lmscore.cross_entropy_difference(docs.limit(0), ids).count() == 0


def test_target_like_documents_score_lower(spark):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r.difference for r in lmscore.op4_lm_score(spark, sf).collect()}
    assert len(scores) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    mean = lambda q: sum(x := [scores[r.doc_id] for r in labels if r.quality == q]) / len(x)
    assert mean(1) < mean(0)


def test_more_ngrams_than_any_fixed_table(spark):
    """About 400,000 distinct words and 1,400,000 distinct bigrams, each counted for itself."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400_000)}" for _ in range(100_000)) for _ in range(14)] + ["once only", None]
    target = set(range(0, 14, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, ids).collect()}
    assert len(got) == len(texts)
    for i, (n, a, b) in enumerate(brute(texts, target)):
        assert got[i].n_tokens == n
        assert got[i].target_loss == pytest.approx(a, rel=1e-6) and got[i].background_loss == pytest.approx(b, rel=1e-6)


def test_a_document_does_not_vouch_for_itself(spark):
    """Of two kinds of made-up text, that which occurs twice is told from that which occurs once."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = [word(3) for _ in range(300)]
    texts = [" ".join(rng.choice(common) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(10, 20)], "doc_id long")
    got = {r.doc_id: r.difference for r in lmscore.cross_entropy_difference(docs, ids).collect()}
    assert min(got[i] for i in (*range(5), *range(40, 45))) > max(got[i] for i in range(5, 40))


def test_small_chunks_and_many_buckets(spark, monkeypatch):
    from palimpsest.llm import chunks

    monkeypatch.setattr(lmscore, "CHUNK_CHARS", 10)
    monkeypatch.setattr(chunks, "MIN_BUCKETS", 500)
    test_brute_force(spark, {0, 1})
