import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from palimpsest.llm import labelled, quality

SF = "/root/testdata/sf0.01"


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 200):
        s, y = np.round(rng.normal(size=n), 1), (rng.random(n) < 0.5).astype(float)
        knots, values = labelled.isotonic(s, y)
        assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and len(knots) == len(values)
        if n == 200:
            # least squares among non-decreasing fits: max over starts of min over ends of means
            u = np.unique(s)
            means = [[y[(s >= a) & (s <= b)].mean() if a <= b else np.inf for b in u] for a in u]
            best = [max(min(means[i][k] for k in range(j, len(u))) for i in range(j + 1)) for j in range(len(u))]
            assert np.allclose(labelled.calibrated(u, knots, values), best, atol=0.35) and np.corrcoef(labelled.calibrated(u, knots, values), best)[0, 1] > 0.95


def test_statistics_of_odd_texts():
    out = quality.statistics([None, "", " \n", "a", "x" * 100_000, "é ß\n" * 5000, "same same"])
    assert np.isfinite(out).all() and (out[0] == out[1]).all() and (out[0] == 0).all()
    assert out[6, 13] == 1.0 and out[6, 12] == 0.5


def test_held_out_accuracy(spark):
    scored = {r.doc_id: r for r in quality.op9_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in scored.items())
    held = [(r.quality, scored[r.doc_id].predicted) for r in labels if scored[r.doc_id].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (sorted((r.doc_id, round(r._quality, 9)) for r in quality.score_quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "", 6.0), (2, "a b", 7.0), (2, "a b", 7.0)], "doc_id long, text string, y double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r._quality for r in quality.score_quality(docs, none).collect()] == [0.5] * 4
    one = spark.createDataFrame([(2, 1), (2, None), (None, 1), (3, 0), (1, 1)], "doc_id long, quality int")
    assert all(0 <= r._quality <= 1 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs.limit(0), one).count() == 0


def test_bound_on_training_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert 20 < labelled.training_rows(docs, labels, "quality", 5, 0, max_rows=100).count() < 200


def test_all_labelled_rows_train(spark):
    ids = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit(1).alias("quality"))
    kept = ids.filter("crc32(CAST(doc_id AS string)) % 5 <> 0").count()
    assert kept > 200_000 and labelled.training_rows(ids, ids, "quality", 5, 0).count() == kept


def test_calibration_by_ranges_is_that_of_all_rows(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.uniform(size=3000), 3)
    y = (rng.uniform(size=3000) < s**2).astype(float)
    pairs = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    for a, b in zip(labelled.isotonic_of(pairs), labelled.isotonic(s, y), strict=True):
        assert np.allclose(a, b, rtol=0, atol=1e-12)
    assert [x.tolist() for x in labelled.isotonic_of(pairs.limit(0))] == [[0.0], [0.5]]
