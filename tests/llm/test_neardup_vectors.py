import math

import duckdb
import numpy as np

from palimpsest.llm import neardup_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, label int, filter string"


def brute(rows):
    ok = [r for r in rows if r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = {id(r): 0 for r in rows}
    comp = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.asarray(a[1], np.float32).astype(float), np.asarray(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    if a[0] is not None and b[0] is not None:
                        p, q = sorted((root(a[0]), root(b[0])))
                        comp[q] = p
    return sorted((str(r[0]), links[id(r)], str(root(r[0]) if r[0] is not None else None)) for r in rows)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in nv.link_vectors(frame).collect())


def clustered(n, d, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(n // 12, 1), d))
    out = []
    for i in range(n):
        x = centres[rng.integers(len(centres))] + spread * rng.standard_normal(d)
        out.append((int(rng.permutation(10**6)[0]) * 1000 + i, [float(v) for v in x], int(rng.integers(2))))
    return out


def test_against_brute_force(spark):
    # neighbours lie on both sides of the threshold
    rows = clustered(700, 64, 1, 0.27)
    want = brute(rows)
    assert sum(n for _, n, _ in want) > 500
    assert got(spark, rows) == want


def test_low_dimensions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 37)
    rows = clustered(150, 3, 2, 0.3)
    assert got(spark, rows) == brute(rows)


def test_crowded_filters_are_split(spark, monkeypatch):
    monkeypatch.setattr(nv, "BLOCK", 23)
    rows = clustered(24, 32, 3, 0.25) + [(10**10 + i, v, 0) for i, (_, v, _) in enumerate(clustered(11, 32, 4, 0.1) * 12)]
    assert got(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    v = [1.0] * 20
    rows = [(1, v, 0), (2, None, 0), (3, [0.0] * 20, 0), (4, [*v[:-1], None], 0), (5, [*v[:-1], float("nan")], 0), (6, [*v[:-1], float("inf")], 0), (7, v, None), (8, v, 1), (9, v, 0), (9, v, 0), (None, v, 0), (10, [], 0), (11, [1.0] * 19, 0), (12, [2.0] * 20, 0), (13, [-1.0] * 20, 0)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_very_small_and_very_large_vectors(spark):
    """What has a square beyond the range of doubles is linked like its multiples."""
    v = [1.0, -2.0, 3.0, 0.5] * 6
    w = [1.0] * 12 + [-1.0] * 12
    scaled = lambda x, by: [c * by for c in x]
    rows = [(1, v, 0), (2, scaled(v, 1e-200), 0), (3, scaled(v, 1e-200), 0), (4, scaled(v, 1e200), 0), (5, scaled(v, 4e307), 0), (6, [5e-324, *[0.0] * 23], 0), (7, [3.0, *[0.0] * 23], 0), (8, scaled(w, 1e250), 0), (9, scaled(w, 1e-300), 0)]
    out = {r.vec_id: r for r in nv.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()}
    assert [(out[i].n_links, out[i].component_id) for i in range(1, 10)] == [(4, 1)] * 5 + [(1, 6)] * 2 + [(1, 8)] * 2


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    n = 3000
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for size in (1000, 100_000):
        words, cap = nv.cap_parameters(size, 64)
        (rx, fx), (ry, fy) = nv.passed_filters(x, words, cap), nv.passed_filters(y, words, cap)
        assert np.bincount(rx, minlength=n).min() >= nv.MIN_FILTERS
        shared = np.intersect1d(rx * words**2 + fx, ry * words**2 + fy) // words**2
        assert n - len(np.unique(shared)) <= 0.001 * n


def test_list_decoding_is_complete():
    x = np.random.default_rng(1).standard_normal((40, 21))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    left, right = nv.codewords(21, 30)
    all_scores = (x[:, :10] @ left.T)[:, :, None] + (x[:, 10:] @ right.T)[:, None, :]
    row, found = nv.list_decode(x, 30, 0.3)
    assert sorted(zip(row, found, strict=True)) == sorted((r, a * 30 + b) for r, a, b in zip(*np.nonzero(all_scores >= 0.3 * math.sqrt(2)), strict=True))


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in nv.op1_embedding_neardup(spark, sf).collect()) == sorted(con.execute(nv.ORACLE_SQL["op1_embedding_neardup"]).fetchall())
