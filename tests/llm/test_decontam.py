import random

import pytest

from palimpsest.llm import decontam

RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(3000)]


def words(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


ITEMS = [words(n) for n in (40, 25, 15, 9, 3)]


def planted(item, changed=()):
    body = [f"X{i}" if i in changed else w for i, w in enumerate(item)]
    return " ".join(words(60) + body + words(60))


def flagged(spark, texts, items=ITEMS, bits=20):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, seed string, item_id int")
    bench = spark.createDataFrame([(i, None if t is None else " ".join(t), "y") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    return sorted({(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench, bits).collect()})


def test_planted_passages(spark):
    texts = [
        planted(ITEMS[0]),
        planted(ITEMS[1], changed=(3, 12, 20)),
        planted(ITEMS[2]).upper().replace(" ", ", "),
        planted(ITEMS[3]),
        planted(ITEMS[3], changed=(4,)),
        planted(ITEMS[4]),
        planted(ITEMS[0][10:32]),
        planted(ITEMS[0][10:24]),
        " ".join(words(500)),
        None,
        "",
        " ".join(ITEMS[0]),
        planted(ITEMS[0]) + " " + planted(ITEMS[1]),
        planted(ITEMS[0]),
    ]
    assert flagged(spark, texts) == [(0, 0), (1, 1), (2, 2), (3, 3), (6, 0), (11, 0), (12, 0), (12, 1), (13, 0)]


def test_every_pair_of_changes_is_survived():
    item = [f"t{i}" for i in range(20)]
    import numpy as np

    from palimpsest.llm.wordhash import hash_words

    own = {(k, s) for k, m in enumerate(decontam.MASKS) for s in decontam.seeds(hash_words([" ".join(item)]).hashes, m, k).tolist()}
    lost = 0
    for a in range(20):
        for b in range(a):
            body = [f"Q{i}" if i in (a, b) else w for i, w in enumerate(item)]
            h = hash_words([" ".join(body)]).hashes
            lost += not any((k, s) in own for k, m in enumerate(decontam.MASKS) for s in decontam.seeds(h, m, k).tolist())
    assert lost == 0 and isinstance(h, np.ndarray)


def test_empty_tables_and_nulls(spark):
    assert flagged(spark, []) == []
    assert flagged(spark, ["a b c"], items=[None, []]) == []


def test_brute_force(spark):
    texts = [planted(RNG.choice(ITEMS[:3]), changed=RNG.sample(range(15), RNG.randint(0, 6))) if RNG.random() < 0.6 else " ".join(words(100)) for _ in range(40)]
    want = set()
    for d, t in enumerate(texts):
        doc = decontam.tokens(t).split()
        for i, item in enumerate(ITEMS[:3]):
            toks = [w.encode().lower() for w in item]
            for p in range(len(doc) - len(toks) + 1):
                n = min(20, len(toks))
                same = [doc[p + j] == toks[j] for j in range(len(toks))]
                if any(sum(same[a : a + n]) >= 0.8 * n for a in range(len(toks) - n + 1)):
                    want.add((d, i))
    got = set(flagged(spark, texts, ITEMS[:3]))
    assert got == want


def test_rows_are_dropped_one_by_one(spark):
    docs = spark.createDataFrame([(1, planted(ITEMS[0])), (1, "clean"), (None, planted(ITEMS[0])), (None, "clean"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(ITEMS[0]))], "item_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in decontam.decontaminate(docs, bench).collect()) == [("1", "clean"), ("2", None), ("None", "clean")]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query(spark, sf):
    found = {r.doc_id for r in decontam.op5_decontaminate(spark, sf).collect()}
    items = [" ".join(decontam.tokens(r.text).decode().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: " ".join(decontam.tokens(r.text).decode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {d for d, t in docs.items() if any(i in t for i in items)} <= found


def longest(doc, item, share=80):
    """Whether any stretch of any diagonal is an overlap, by trying all."""
    need = min(20, len(item))
    for shift in range(len(item) - need, need - len(doc) - 1, -1):
        same = [doc[i] == item[i + shift] for i in range(max(0, -shift), min(len(doc), len(item) - shift))]
        total = [0]
        for x in same:
            total.append(total[-1] + x)
        if any(100 * (total[b] - total[a]) >= share * (b - a) for a in range(len(total)) for b in range(a + need, len(total))):
            return True
    return False


def test_every_overlap_within_the_share_is_found(spark):
    """Items of 13 to 40 tokens with as many changes as are allowed, and one more: nothing is lost."""
    rng = random.Random(3)
    items = [words(n) for n in range(13, 41)]
    cases = [(i, rng.sample(range(len(item)), len(item) // 5 + more)) for i, item in enumerate(items) for more in (0, 0, 0, 0, 1)]
    cases += [(2, (3, 7, 11)), (0, (0, 12)), (0, (4, 8)), (7, (3, 7, 11, 15)), (12, (4, 8, 12, 16, 20))]
    texts = [" ".join(words(5) + [f"X{j}" if j in changed else w for j, w in enumerate(items[i])] + words(5)) for i, changed in cases]
    low = [[w.lower() for w in item] for item in items]
    want = sorted({(d, i) for d, t in enumerate(texts) for i in range(len(items)) if longest(t.lower().split(), low[i])})
    assert len(want) >= 4 * len(items)
    assert flagged(spark, texts, items) == want


def test_a_long_overlap_is_reported_whole(spark):
    item = words(300)
    docs = spark.createDataFrame([(None, " ".join(words(50) + item + words(50)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    (r,) = decontam.overlaps(docs, bench, 20).collect()
    assert r.doc_start <= 50 and r.doc_end >= 350 and r.equal >= 300 and r.doc_id is None


def test_verified_is_the_longest_stretch():
    rng = random.Random(9)
    for n in (5, 13, 16, 20, 33, 60):
        for _ in range(30):
            item, shift = [str(i) for i in range(n)], rng.randint(-8, 8)
            doc = [item[i + shift] if 0 <= i + shift < n and rng.random() < 0.82 else "x" for i in range(70)]
            low, high, need = max(0, -shift), min(70, n - shift), min(20, n)
            best = None
            for size in range(high - low, need - 1, -1):
                found = [(-sum(doc[i] == item[i + shift] for i in range(a, a + size)), a) for a in range(low, high - size + 1)]
                equal, a = min(found)
                if -100 * equal >= (80 if n >= 13 else 100) * size:
                    best = (a, a + size, a + shift, -equal)
                    break
            assert decontam.verified(doc, item, shift) == best


def test_no_allowed_changes_leave_the_masks_without_a_hit():
    """Least changes that avoid every hit, by dynamic programming over the last places."""
    span = max(map(len, decontam.MASKS))
    selected = [int(m, 2) for m in decontam.MASKS]
    assert all("0" in m and m[0] == m[-1] == "1" for m in decontam.MASKS)
    for n in range(13, 40):  # a longer stretch has a part of 20 to 39 with the share
        least = {0: 0}
        for _ in range(n):
            after = {}
            for last, changes in least.items():
                for equal in (0, 1):
                    places = last << 1 | equal
                    if not any(places & m == m for m in selected):
                        key = places & ((1 << (span - 1)) - 1)
                        after[key] = min(after.get(key, 99), changes + 1 - equal)
            least = after
        assert min(least.values()) > n // 5, n
