"""Scans, top-k, fusion and packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import retrieval as op
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import EPISODES, NOW_MS, OBSERVATIONS, POLICIES, SKEW_MS, table, with_

TERMS = ["the", "re"]
GUARD = f"owner_host = 'alpha' AND status = 'active' AND secret_scan = 'passed' AND privacy_epoch = 1 AND (expires_at IS NULL OR expires_at > {NOW_MS + SKEW_MS})"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


_SCORED = "(SELECT e.vec_id, e.label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes over one id space: dense vectors, exact terms, recency."""
    dense = op.vector_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20).select(F.lit("dense").alias("lane"), F.col("vec_id").alias("n"), F.col("score").alias("raw_score"))
    exact = table(spark, sf_dir, "documents").filter(op.contains_terms(F.col("text"), TERMS)).select(F.lit("exact").alias("lane"), F.col("doc_id").alias("n"), F.lit(1.0).alias("raw_score")).orderBy("n").limit(20)
    recent = rec.observations(spark, sf_dir).orderBy(F.desc("effective_at"), F.desc("event_id")).limit(20).select(F.lit("recent").alias("lane"), F.col("event_id").alias("n"), F.col("effective_at").cast("double").alias("raw_score"))
    return dense.unionByName(exact).unionByName(recent).select(
        F.concat(F.lit("m-"), "n").alias("id"),
        "lane",
        "raw_score",
        F.when(F.col("n") % 3 == 0, "p0").alias("project_id"),
        F.when(F.col("n") % 5 == 0, F.concat(F.lit("c"), F.col("n") % 10)).alias("content_id"),
        F.lit(None).cast("string").alias("observation_id"),
        F.array(F.concat(F.lit("e"), F.floor(F.col("n") / 2).cast("long"))).alias("evidence_ids"),
    )


_LANES = f"""
lanes AS (
  SELECT 'm-' || n AS id, lane, raw_score, n, CASE WHEN n % 3 = 0 THEN 'p0' END AS project_id,
    CASE WHEN n % 5 = 0 THEN 'content:c' || (n % 10) ELSE 'evidence:e' || (n // 2) END AS evidence_key
  FROM (
    SELECT * FROM (SELECT 'dense' AS lane, vec_id AS n, score AS raw_score FROM {_SCORED} ORDER BY score DESC, vec_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'exact', doc_id, 1.0 FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 're') ORDER BY doc_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'recent', event_id, CAST(epoch_us(ts) // 1000 AS DOUBLE) FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)
  )
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lane ORDER BY raw_score DESC, id) AS rank FROM lanes
), fused AS (
  SELECT id, round(sum(1.0 / (60 + rank) + CASE WHEN project_id IS NOT NULL THEN 0.05 ELSE 0.0 END), 9) AS score,
    arg_min(evidence_key, lane) AS evidence_key, min(lane) AS lane
  FROM ranked GROUP BY id
)"""


@query("retrieval_rrf_topk", with_(_LANES) + "SELECT id, CAST(score AS DOUBLE) AS score, evidence_key, lane FROM (SELECT *, row_number() OVER (PARTITION BY evidence_key ORDER BY score DESC, id) AS k FROM fused) WHERE k = 1 ORDER BY score DESC, id LIMIT 10")
def retrieval_rrf_topk(spark, sf_dir):
    """Lanes ranked, fused and deduplicated by evidence, best ten."""
    return op.fuse(_lanes(spark, sf_dir), limit=10, boost=0.05, lane_order=["dense", "exact", "recent"])


@query("w1_lane_rank", with_(_LANES) + "SELECT lane, id, rank FROM ranked WHERE rank <= 7")
def w1_lane_rank(spark, sf_dir):
    """Rank within each lane, ties by id."""
    return op.rank_lanes(_lanes(spark, sf_dir), per_lane=7).select("lane", "id", F.col("rank").cast("long").alias("rank"))


@query("s3_scroll", with_(EPISODES) + "SELECT id, event_kind FROM episodes WHERE id > 'ep-3' ORDER BY id LIMIT 100")
def s3_scroll(spark, sf_dir):
    """S3: one keyset page."""
    return rec.episodes(spark, sf_dir).filter(F.col("id") > "ep-3").select("id", "event_kind").orderBy("id").limit(100)


@query("s5_multi_get", with_(EPISODES) + "SELECT id, text FROM episodes WHERE id IN (SELECT 'ep-' || item_id || '-0' FROM benchmark)")
def s5_multi_get(spark, sf_dir):
    """Lookup of a list of ids."""
    ids = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("ep-"), "item_id", F.lit("-0")).alias("id")).distinct()
    return rec.episodes(spark, sf_dir).join(ids, "id", "left_semi").select("id", "text")


@query("s6_evidence_lookup", with_(EPISODES, OBSERVATIONS) + """
SELECT id, kind, count(*) OVER (PARTITION BY id) AS n FROM (
  SELECT id, 'episode' AS kind FROM episodes UNION ALL SELECT id, 'curated_memory' FROM observations UNION ALL SELECT DISTINCT state_key, 'curated_current' FROM observations
) WHERE id IN (SELECT evidence_id FROM observations UNION ALL SELECT state_key FROM observations)""")
def s6_evidence_lookup(spark, sf_dir):
    """Ids over several record types; an ambiguous one fails the lookup."""
    obs = rec.observations(spark, sf_dir)
    everything = rec.episodes(spark, sf_dir).select("id", F.lit("episode").alias("kind")).unionByName(obs.select("id", F.lit("curated_memory").alias("kind"))).unionByName(obs.select(F.col("state_key").alias("id"), F.lit("curated_current").alias("kind")).distinct())
    wanted = obs.select(F.col("evidence_id").alias("id")).unionByName(obs.select(F.col("state_key").alias("id")))
    return op.lookup(everything, wanted)


@query("s7_dimension_reads", with_(EPISODES, POLICIES, "ids AS (SELECT DISTINCT processing_policy_id AS policy_id FROM episodes)") + "SELECT policy_id, residency, store_id FROM policies WHERE policy_id IN (SELECT policy_id FROM ids)")
def s7_dimension_reads(spark, sf_dir):
    """Policies by a bounded list of distinct ids; a longer one is refused."""
    # as many ids as policies are in use, and 1,024 at most
    ids = [r[0] for r in rec.episodes(spark, sf_dir).select("processing_policy_id").distinct().limit(1025).collect()]
    return op.bounded_lookup(rec.policies(spark, sf_dir), ids, "policy_id").select("policy_id", "residency", "store_id")


@query("s8_vector_topk", f"SELECT vec_id, score FROM {_SCORED} ORDER BY score DESC, vec_id LIMIT 20")
def s8_vector_topk(spark, sf_dir):
    """Exact top-k by dot product."""
    return op.vector_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20).select("vec_id", "score")


@query("f11_min_score", f"SELECT vec_id, score FROM {_SCORED} WHERE score >= 0.35 ORDER BY score DESC, vec_id LIMIT 100")
def f11_min_score(spark, sf_dir):
    """dense results over the least score."""
    return op.vector_top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 100, least=0.35).select("vec_id", "score")


@query("s9_count", with_(EPISODES) + f"SELECT count(*) AS n FROM episodes WHERE {GUARD}")
def s9_count(spark, sf_dir):
    """Exact count under the read guard."""
    return rec.episodes(spark, sf_dir).filter(op.read_guard("alpha", 1, NOW_MS, SKEW_MS)).agg(F.count(F.lit(1)).alias("n"))


@query("s10_collection_info", "SELECT count(*) AS n, CAST(min(len(embedding)) AS BIGINT) AS least_dimension, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings")
def s10_collection_info(spark, sf_dir):
    """Size and dimension of the vector collection."""
    size = F.size("embedding").cast("long")
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least_dimension"), F.max(size).alias("dimension"))


@query("x16_canonical_vector", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 4) AS norm, round(v[1], 5) AS head FROM (SELECT vec_id, list_transform(e, lambda x: CAST(x / sqrt(list_sum(list_transform(e, lambda y: y * y))) AS FLOAT)::DOUBLE) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))")
def x16_canonical_vector(spark, sf_dir):
    """Vectors scaled to unit length and rounded to single precision."""
    wide = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    unit = table(spark, sf_dir, "embeddings").withColumn("norm", norm).withColumn("v", F.transform(wide, lambda x: (x / F.col("norm")).cast("float").cast("double")))
    return unit.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"), F.round(F.element_at("v", 1), 5).alias("head"))


@query("a8_mean_vector", "SELECT label, place, round(avg(x), 6) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS place FROM embeddings) GROUP BY label, place")
def a8_mean_vector(spark, sf_dir):
    """Element-wise mean of the vectors of a label."""
    wide = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))
    return wide.groupBy("label", F.col("place").cast("long").alias("place")).agg(F.round(F.avg("x"), 6).alias("x"))


@query("w9_context_pack", with_(EPISODES, """
h AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS position, text, chr(10) || '(' || event_kind || ')' AS suffix FROM episodes WHERE text <> ''), f AS (
  SELECT *, '[' || position || '] ' AS prefix, length('[' || position || '] ' || text || suffix) AS size FROM h WHERE position <= 10), r AS (
  SELECT *, 1200 - coalesce(sum(size) OVER (PARTITION BY session_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f)""") + """
SELECT session_id, position, CASE WHEN size <= room THEN prefix || text || suffix ELSE prefix || left(text, CAST(room - length(prefix) - length(suffix) - 1 AS INT)) || '…' || suffix END AS entry
FROM r WHERE room > 0 AND (size <= room OR room - length(prefix) - length(suffix) > 0)""")
def w9_context_pack(spark, sf_dir):
    """The first ten hits of each answer (here a session) packed into a character budget; the first that does not fit is cut."""
    placed = rec.episodes(spark, sf_dir).filter("text <> ''").withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy("id")).cast("long")).filter("position <= 10")
    return op.pack(placed.select("session_id", "position", "text", F.concat(F.lit("\n("), "event_kind", F.lit(")")).alias("suffix")), 1200, "session_id")


@query("t4_inspect_page", with_(EPISODES) + "SELECT id, event_kind, status, (SELECT count(*) > 50 FROM episodes) AS truncated FROM episodes ORDER BY id LIMIT 50")
def t4_inspect_page(spark, sf_dir):
    """P8, T4, AD5: allow-listed columns of one page, and whether more follow."""
    ep = rec.episodes(spark, sf_dir).select("id", "event_kind", "status").orderBy("id")
    more = ep.limit(51).agg((F.count(F.lit(1)) > 50).alias("truncated"))
    return ep.limit(50).join(F.broadcast(more), F.lit(True))


@query("t6_recall_at_5", f"SELECT count(*) AS hits FROM (SELECT vec_id FROM {_SCORED} ORDER BY score DESC, vec_id LIMIT 5) a JOIN (SELECT vec_id FROM {_SCORED} WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, vec_id LIMIT 5) b USING (vec_id)")
def t6_recall_at_5(spark, sf_dir):
    """How many of the flat top five a search within the query's own cluster finds."""
    vectors, q = table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    own = vectors.filter("vec_id = 0").select("label")
    flat = op.vector_top_k(vectors, q, 5).select("vec_id")
    near = op.vector_top_k(vectors.join(F.broadcast(own), "label", "left_semi"), q, 5).select("vec_id")
    return flat.join(near, "vec_id").agg(F.count(F.lit(1)).alias("hits"))
