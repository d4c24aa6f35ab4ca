import hashlib
import random
import re

import duckdb
import pytest

from palimpsest.llm import substrings as sub

RNG = random.Random(8)
VOCAB = [f"w{i}" for i in range(300)]


def words(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def brute(rows):
    docs = [(i if i is not None else sub.NO_ID, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, w), (raw, _) in zip(docs, rows, strict=True):
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone |= set(range(p, p + 13))
        out.append((str(raw), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def got(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, start int")
    out = sub.remove_repeated(frame)
    assert out.columns == ["doc_id", "text", "fp", "start", "_n_words", "_n_removed"]
    return sorted((str(r.doc_id), r._n_words, r._n_removed, " ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect())


def corpus():
    shared = [words(n) for n in (13, 12, 20, 60, 200)]
    texts = []
    for _ in range(60):
        body = words(RNG.randint(0, 60))
        for _ in range(RNG.randint(0, 2)):
            s = RNG.choice(shared)
            a = RNG.randint(0, len(s) - 1)
            cut = s[a : a + RNG.randint(1, len(s))] if RNG.random() < 0.5 else s
            at = RNG.randint(0, len(body))
            body = body[:at] + cut + body[at:]
        texts.append(RNG.choice(["  ", " ", "\n", "\t"]).join(body))
    texts += [texts[3], texts[3], None, "", " ", "For " * 400, "For " * 200 + "x", "é ß 字 " * 10, "é ß 字 " * 10]
    ids = RNG.sample(range(10**6), len(texts))
    rows = list(zip(ids, texts, strict=True)) + [(None, " ".join(shared[3])), (ids[0], " ".join(shared[4])), (ids[0], " ".join(shared[4])), (max(ids) + 1, texts[0])]
    RNG.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # several automata, crowded bitmap
        monkeypatch.setattr(sub, "SHARD_PASSAGES", 7)
        monkeypatch.setattr(sub, "HEAVY", 3)
    rows = corpus()
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert got(spark, rows) == want


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "a b")]) == [("1", 0, 0, ""), ("2", 2, 0, "a b")]


def test_untouched_texts_stay_as_they_are(spark):
    out = sub.remove_repeated(spark.createDataFrame([(1, " a\n\nb  c "), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in out} == {1: " a\n\nb  c ", 2: None}


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = sorted(tuple(r) for r in sub.op7_substring_dedup(spark, sf).collect())
    assert rows == sorted(con.execute(sub.ORACLE_SQL["op7_substring_dedup"]).fetchall())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(d == hashlib.sha256(" ".join(texts[i].split()).encode()).hexdigest() for i, n, g, d in rows[:5] if not g)
