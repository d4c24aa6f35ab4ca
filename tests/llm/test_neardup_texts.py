import random
import re

import duckdb
import numpy as np

from palimpsest.llm import neardup_texts as nt
from palimpsest.llm.wordhash import hash_words

RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(2000)]


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def edited(t, changes):
    words = t.split()
    for i in RNG.sample(range(len(words)), changes):
        words[i] = "X" + words[i]
    return " ".join(words)


def sets(t):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    rows = [(i, sets(t)) for i, t in rows]
    comp = {i: i for i, _ in rows if i is not None}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = sorted((root(i), root(j)))
                comp[q] = p
    return sorted((str(i), len(a), str(root(i) if i is not None else None)) for i, a in rows)


def got(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, th string, n int")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nt.group_near_duplicates(frame).collect())


def test_against_brute_force(spark):
    rows, base = [], [text(n) for n in (400, 300, 60, 30, 12)]
    for t in base:
        n = len(t.split())
        for c in range(0, n // 20 + 3):
            rows.append(edited(t, min(c // 2, n)))
    # a chain whose ends are not alike, copies, short and odd texts
    chain = text(200).split()
    for _ in range(12):
        chain = chain[6:] + text(6).split()
        rows.append(" ".join(chain))
    rows += [base[0].upper()] * 3 + ["", None, " \n", "a", "A", "a b c", "a b c ", "a b c d", "É x", "é x", "\x1ca"] + [text(100) for _ in range(20)]
    RNG.shuffle(rows)
    ids = RNG.sample(range(10**6), len(rows))
    table = list(zip(ids, rows, strict=True)) + [(None, base[0]), (ids[0], base[1]), (ids[0], base[1])]
    want = brute(table)
    assert got(spark, table) == want
    assert len({c for _, _, c in want}) < len(rows) - 30


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [("1", 0, "1")]


def test_large_group_and_bridge(spark):
    base = text(300)
    table = [(i, edited(base, 3)) for i in range(60)] + [(100 + i, base) for i in range(60)]
    assert got(spark, table) == brute(table)


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(nt, "BLOCK", 7)
    base = text(200)
    # most pairs are near the threshold, on both sides of it
    table = [(i, edited(base, RNG.randint(2, 6))) for i in range(70)]
    assert got(spark, table) == brute(table)


def test_registers_merge_and_estimate():
    a, b = text(900).split(), text(300).split()
    whole, left, right = (nt.shingles(hash_words([" ".join(x)])) for x in (a + b, a + b[:4], a[-4:] + b))
    regs = [nt.registers(t, h, 1)[0] for t, h in (whole, left, right)]
    union = np.union1d(left[1], right[1])
    joined = nt.registers(np.zeros(len(union), np.int64), union, 1)[0]
    assert (nt.merged(regs[1], regs[2]) == joined).all()
    size = np.asarray([len(whole[1])]), np.asarray([len(left[1])])
    true = len(np.intersect1d(whole[1], left[1])) / len(np.union1d(whole[1], left[1]))
    assert abs(nt.likely_similarity(*size, regs[0][None], regs[1][None])[0] - true) < 0.17


def test_registers_estimate_without_bias():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 330, dtype=np.uint64)
        a, b = x[:300], x[30:]
        regs = [nt.registers(np.zeros(len(s), np.int64), s, 1) for s in (a, b)]
        errors.append(nt.likely_similarity(np.asarray([300]), np.asarray([300]), *regs)[0] - 270 / 330)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


def test_kept_rows(spark):
    base = text(100)
    docs = spark.createDataFrame([(3, base, "a"), (1, base, "b"), (None, base, "c"), (2, "other", "d")], "doc_id long, text string, lang string")
    assert sorted(r.lang for r in nt.drop_near_duplicates(docs).collect()) == ["b", "c", "d"]


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in nt.op2_minhash_neardup(spark, sf).collect()) == sorted(con.execute(nt.ORACLE_SQL["op2_minhash_neardup"]).fetchall())
