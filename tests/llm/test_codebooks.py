"""Vector codes against plain Python integers, and SQL on the small tables."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import codebooks

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, rounds=6):
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // 8)
    kept = [(i, label, [math.floor(x * 4096) if abs(x) < 2**53 else int(x) * 4096 for x in v] + [0] * (8 * width - len(v))) for i, label, v in kept]
    cut = [[v[p * width : (p + 1) * width] for _, _, v in kept] for p in range(8)]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, rows.index(rows[r])))[:16]
    books = [[cut[p][r] for r in order] for p in range(8)]

    def closest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = []
        for p in range(8):
            to = [closest(p, x)[1] for x in cut[p]]
            new = []
            for k, e in enumerate(books[p]):
                own = [x for x, t in zip(cut[p], to, strict=True) if t == k]
                new.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else e)
            found.append(new)
        books = found
    out = []
    for r, (i, label, _) in enumerate(kept):
        best = [closest(p, cut[p][r]) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error if error < 2**63 else None, fits([e for _, o, _, e in out if o == label]), digest) for i, label, code, error in out), key=str)


def fits(errors):
    return sum(errors) if sum(errors) < 2**63 else None


def result(frame):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codebooks.compress(frame).collect()), key=str)


def test_table_equals_plain_and_sql(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in table.orderBy("vec_id").collect()]
    got = result(table)
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({codebooks.ORACLE_SQL['op11_vector_codes']})").fetchall()
    assert sorted(sql, key=str) == got


def test_odd_vectors_and_labels(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, 1, 2][i % 3], (rng.integers(-3, 4, 16) / 4096).tolist()) for i in range(60)]
    rows += [(100, 1, None), (101, 1, [None] * 16), (102, 1, [float("nan")] * 16), (103, 2, [float("inf")] + [0.0] * 15), (104, None, [0.0] * 16), (104, None, [-0.0] * 16)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for extra in ("v", "code", "error", "slot", "value", "row_label", "of_label", "sum"):
        frame = frame.withColumn(extra, F.lit("clash"))
    assert result(frame) == brute(rows)


@pytest.mark.parametrize("size", [1e-200, 1e3, 1e9, 1e30, 1e300])
def test_any_finite_size(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.standard_normal(8) * (size if i % 3 else 1)).tolist()) for i in range(40)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_few_uneven_and_empty(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, 1, None)], SCHEMA)) == []
    few = [(1, None, [0.5, 0.25, 1.0]), (2, None, [0.5]), (3, 7, [0.1] * 11)]
    assert result(spark.createDataFrame(few, SCHEMA)) == brute(few)


def test_ties_go_to_the_lower_index():
    entries = np.asarray([[2, 0], [0, 2], [-2, 0], [0, -2], [2, 0], [0, 0], [0, 0]] * 2)
    points = np.asarray([[x, y] for x in range(-3, 4) for y in range(-3, 4)])
    index, best = codebooks.nearest(codebooks.kd_tree(entries), entries, points)
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
