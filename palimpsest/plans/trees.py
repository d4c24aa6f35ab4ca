"""Clustering, trees and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import raptor as op
from palimpsest.plans.registry import query
from palimpsest.sources.records import table


def _leaves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("grp"), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (F.col("vec_id") % 40 + 10).alias("tokens"))


@query("m2_soft_clusters")
def m2_soft_clusters(spark, sf_dir):
    """M1 to M5: reduction, mixtures by BIC and soft assignment within each label (iterative; tested for invariants)."""
    return op.cluster_groups(_leaves(spark, sf_dir), "grp")


@query("m6_tree")
def m6_tree(spark, sf_dir):
    """M6: edges of the soft tree, each one level up (iterative; tested for invariants)."""
    return op.build_tree(_leaves(spark, sf_dir), budget=400)[1]


@query("m4_assignments", "SELECT vec_id, list_position(p, list_max(p)) AS best, len(list_filter(p, lambda x: x >= 0.1)) AS n_clusters FROM (SELECT vec_id, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[])[1:8], lambda x: x * x + 0.000001) AS w FROM embeddings))")
def m4_assignments(spark, sf_dir):
    """M4: soft assignment of a table of memberships."""
    w = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x: x * x + 0.000001)
    p = table(spark, sf_dir, "embeddings").select("vec_id", w.alias("w")).withColumn("s", F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).withColumn("p", F.transform("w", lambda x: x / F.col("s")))
    return p.select("vec_id", F.array_position("p", F.array_max("p")).cast("int").alias("best"), F.size(F.filter("p", lambda x: x >= 0.1)).cast("long").alias("n_clusters"))


@query("m9_summary_reuse", "SELECT label, sha256(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) || '|prompt-1|model-1') AS reuse_key FROM embeddings GROUP BY label")
def m9_summary_reuse(spark, sf_dir):
    """M8, M9: the key under which a summary may be used again."""
    members = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda v: v.cast("string")), ",")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sha2(F.concat(members, F.lit("|prompt-1|model-1")), 256).alias("reuse_key"))


@query("m10_extractive_summary", "WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3), s AS (SELECT source, CAST(sum(strlen(left(text, 400))) AS BIGINT) AS bytes, string_agg(left(left(text, 400), 40), ' ' ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS summary FROM k GROUP BY source) SELECT source, CASE WHEN bytes <= 1220 THEN summary END AS summary, CASE WHEN bytes > 1220 THEN 'over budget' END AS error FROM s")
def m10_extractive_summary(spark, sf_dir):
    """An injected summariser (here openings) over each cluster's members, refused where they exceed four bytes a token."""
    from pyspark.sql import Window

    from palimpsest.functions.seams import summarise

    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    top = table(spark, sf_dir, "documents").withColumn("k", k).filter("k <= 3")
    members = top.select(F.col("source").alias("cluster"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("member"), F.left("text", F.lit(400)).alias("text"))
    return summarise(members, lambda texts: " ".join(t[:40] for t in texts), 305).withColumnRenamed("cluster", "source")
