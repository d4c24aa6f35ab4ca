"""Barriers, anti-joins, policies, set operations and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import identity as ident
from palimpsest.operators import coordination as co
from palimpsest.operators import retrieval as op
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, DAY_MS, EPISODES, NOW_MS, OBSERVATIONS, POLICIES, SKEW_MS, TOMBSTONES, table, with_

_ITEMS = """
items AS (SELECT state_key AS id, content_id, list_sort(list(DISTINCT evidence_id)) AS evidence_ids FROM observations GROUP BY state_key, content_id)"""


def _items(spark, sf_dir):
    return rec.observations(spark, sf_dir).groupBy(F.col("state_key").alias("id"), "content_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def _keyed_items(spark, sf_dir):
    return _items(spark, sf_dir).select(F.concat("id", F.lit("/"), "content_id").alias("id"), "content_id", F.col("id").alias("state_key"), "evidence_ids")


@query("j1_evidence_join", with_(EPISODES, OBSERVATIONS, _ITEMS) + "SELECT i.id || '/' || i.content_id AS id FROM items i WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(i.evidence_ids) AS e) x WHERE x.e NOT IN (SELECT id FROM episodes))")
def j1_evidence_join(spark, sf_dir):
    """Candidates whose every piece of evidence resolves."""
    return op.with_all_evidence(_keyed_items(spark, sf_dir), rec.episodes(spark, sf_dir)).select("id")


@query("j2_strict_barrier", with_(EPISODES) + f"SELECT id FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM episodes b WHERE b.session_id = e.session_id AND (b.expires_at <= {BASE_MS + 10 * DAY_MS + SKEW_MS} OR b.status <> 'active' OR b.secret_scan <> 'passed' OR b.privacy_epoch <> 1))")
def j2_strict_barrier(spark, sf_dir):
    """All rows of an answer (here a session), or none where one piece of its evidence fails the guard."""
    rows = rec.episodes(spark, sf_dir)
    good = op.not_expired(BASE_MS + 10 * DAY_MS, SKEW_MS) & (F.col("status") == "active") & (F.col("secret_scan") == "passed") & (F.col("privacy_epoch") == 1)
    return op.strict_barrier(rows, rows.filter(~good), "session_id").select("id")


@query("j4_tombstone_barrier", with_(EPISODES, OBSERVATIONS, TOMBSTONES, _ITEMS) + "SELECT id || '/' || content_id AS id FROM items i WHERE NOT EXISTS (SELECT 1 FROM items x WHERE x.id = i.id AND (x.id IN (SELECT target_id FROM tombstones) OR EXISTS (SELECT 1 FROM (SELECT unnest(x.evidence_ids) AS e) y JOIN tombstones t ON t.target_id = y.e)))")
def j4_tombstone_barrier(spark, sf_dir):
    """All candidates of an answer (here a state), or none where a target of any is forgotten."""
    rows = _keyed_items(spark, sf_dir)
    return op.strict_barrier(rows, co.forgotten(rows, rec.tombstones(spark, sf_dir)), "state_key").select("id")


@query("j5_visible", with_(EPISODES, OBSERVATIONS, TOMBSTONES, _ITEMS) + "SELECT id || '/' || content_id AS id FROM items i WHERE id NOT IN (SELECT target_id FROM tombstones) AND content_id NOT IN (SELECT target_id FROM tombstones) AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(i.evidence_ids) AS e) x JOIN tombstones t ON t.target_id = x.e)")
def j5_visible(spark, sf_dir):
    """Records without those that a tombstone hides."""
    return co.visible(_keyed_items(spark, sf_dir), rec.tombstones(spark, sf_dir)).select("id")


@query("j6_uncovered", with_(EPISODES, OBSERVATIONS) + "SELECT id FROM episodes WHERE id NOT IN (SELECT evidence_id FROM observations WHERE value > 50)")
def j6_uncovered(spark, sf_dir):
    """J6, U3, AD6: episodes that no coverage row marks."""
    coverage = rec.observations(spark, sf_dir).filter("value > 50").select(F.col("evidence_id").alias("id")).distinct()
    return co.uncovered(rec.episodes(spark, sf_dir), coverage, ["id"]).select("id")


@query("j7_delta", "SELECT label, count(*) AS n_new, count(*) >= 5 AS rebuild FROM (SELECT label, vec_id FROM embeddings EXCEPT SELECT label, vec_id FROM embeddings WHERE vec_id % 10 <> 3) GROUP BY label")
def j7_delta(spark, sf_dir):
    """Leaves that the last generation lacks, and whether they call for a new one."""
    now = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    delta = now.join(now.filter("vec_id % 10 <> 3"), ["label", "vec_id"], "left_anti")
    return delta.groupBy("label").agg(F.count(F.lit(1)).alias("n_new")).withColumn("rebuild", F.col("n_new") >= 5)


_WORKER = {"policy_id": "polW", "owner_host": "alpha", "residency": "eu", "data_use": "memory", "store_id": "store0", "embedding_id": "embed0", "llm_id": "llm0", "origin": "any", "allow_replay": True, "expires_at": NOW_MS}
_USABLE = "residency = 'eu' AND store_id = 'store0' AND embedding_id = 'embed0' AND llm_id = 'llm0'"


def _spread(spark, sf_dir):
    """Episodes under fifty policies."""
    return rec.episodes(spark, sf_dir).withColumn("processing_policy_id", F.concat(F.lit("pol"), F.col("conv_id") % 50))


@query("j9_policy_groups", with_(EPISODES, POLICIES) + f"SELECT policy_id, row_number() OVER (ORDER BY policy_id) AS position, n, least(coalesce(expires_at, {NOW_MS}), {NOW_MS}) AS expires_at, allow_replay, sha256(policy_id || '|polW') AS revision FROM policies JOIN (SELECT 'pol' || (conv_id % 50) AS policy_id, count(*) AS n FROM episodes GROUP BY 1) USING (policy_id) WHERE {_USABLE}")
def j9_policy_groups(spark, sf_dir):
    """Episodes by the intersection of their policy with the worker's, in order of policy."""
    groups, _ = co.group_by_policy(_spread(spark, sf_dir), rec.policies(spark, sf_dir), _WORKER)
    return groups.select(F.col("processing_policy_id").alias("policy_id"), "position", "n", "expires_at", "allow_replay", "revision")


@query("j9_pending", with_(EPISODES, POLICIES) + f"SELECT id FROM episodes WHERE 'pol' || (conv_id % 50) NOT IN (SELECT policy_id FROM policies WHERE {_USABLE})")
def j9_pending(spark, sf_dir):
    """Episodes whose policy a worker's does not meet stay pending."""
    return co.group_by_policy(_spread(spark, sf_dir), rec.policies(spark, sf_dir), _WORKER)[1]


_EDGES = "edges AS (SELECT l_orderkey // 8 AS parent, l_orderkey AS child FROM lineitem WHERE l_orderkey > 0 GROUP BY l_orderkey)"


@query("j10_descent", with_(_EDGES, """
d(id, score, depth) AS (SELECT CAST(1 AS BIGINT), CAST(1.0 AS DOUBLE), 0 UNION ALL SELECT e.child, d.score, d.depth + 1 FROM d JOIN edges e ON e.parent = d.id WHERE d.depth < 10)""", recursive=True) + "SELECT id, max(score) AS score, min(depth) AS depth FROM d GROUP BY id")
def j10_descent(spark, sf_dir):
    """Everything down to ten levels below a root, level by level."""
    edges = table(spark, sf_dir, "lineitem").filter("l_orderkey > 0").select(F.floor(F.col("l_orderkey") / 8).cast("long").alias("parent"), F.col("l_orderkey").alias("child")).distinct()
    roots = spark.createDataFrame([(1, 1.0)], "id long, score double")
    return co.descend(roots, edges, 10)


@query("a6_policy_intersection", with_(POLICIES, """
m AS (SELECT store_id || '/' || embedding_id AS grp, * FROM policies)""") + """
SELECT grp, c AS compatible, CASE WHEN c THEN residency END AS residency, CASE WHEN c THEN store_id END AS store_id, CASE WHEN c THEN llm_id END AS llm_id, CASE WHEN c THEN allow_replay END AS allow_replay, CASE WHEN c THEN expires_at END AS expires_at, CASE WHEN c THEN revision END AS revision FROM (
  SELECT grp, count(DISTINCT residency) = 1 AND count(DISTINCT store_id) = 1 AND count(DISTINCT embedding_id) = 1 AND count(DISTINCT coalesce(llm_id, '')) = 1 AND count(DISTINCT origin) = 1 AS c,
    min(residency) AS residency, min(store_id) AS store_id, min(llm_id) AS llm_id, bool_and(allow_replay) AS allow_replay, min(expires_at) AS expires_at,
    sha256(string_agg(DISTINCT policy_id, ',' ORDER BY policy_id)) AS revision
  FROM m GROUP BY grp)""")
def a6_policy_intersection(spark, sf_dir):
    """What all policies of a group allow."""
    members = rec.policies(spark, sf_dir).withColumn("grp", F.concat("store_id", F.lit("/"), "embedding_id"))
    return co.intersect_policies(members, "grp")


@query("a7_cluster_range", with_(EPISODES) + "SELECT session_id, min(event_at) AS temporal_from, max(event_at) AS temporal_to, coalesce(string_agg(DISTINCT project_id, ',' ORDER BY project_id), '') AS covered_projects, CAST(sum(greatest(1, ceil(strlen(text) / 4) + 32, 12)) AS BIGINT) AS tokens FROM episodes GROUP BY session_id")
def a7_cluster_range(spark, sf_dir):
    """Range, projects and token estimate of each cluster; a member counts by its bytes, and for a share of the budget at least."""
    estimate = op.token_estimate(F.col("text"), 12_000)
    return rec.episodes(spark, sf_dir).groupBy("session_id").agg(F.min("event_at").alias("temporal_from"), F.max("event_at").alias("temporal_to"), F.array_join(F.array_sort(F.collect_set("project_id")), ",").alias("covered_projects"), F.sum(estimate).cast("long").alias("tokens"))


@query("a15_uniqueness", with_(EPISODES) + "SELECT count(*) AS n, count(DISTINCT id) AS n_ids, count(*) = count(DISTINCT id) AS unique_ids FROM episodes")
def a15_uniqueness(spark, sf_dir):
    """The cardinality check of every typed scan."""
    return rec.episodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), (F.count(F.lit(1)) == F.countDistinct("id")).alias("unique_ids"))


_MERKLE = """
n AS (SELECT conv_id AS grp, id, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS k FROM episodes),
c AS (SELECT grp, (k - 1) // 2 AS chunk, count(*) AS size, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM n GROUP BY 1, 2),
t(grp, hs) AS (SELECT grp, list(h ORDER BY chunk) FROM c GROUP BY grp UNION ALL SELECT grp, list_transform(list_filter(range(1, len(hs) + 1), lambda i: i % 2 = 1), lambda i: sha256('{"left":"' || hs[i] || '","right":"' || hs[least(i + 1, len(hs))] || '"}')) FROM t WHERE len(hs) > 1)"""


@query("a17_manifest", with_(EPISODES, _MERKLE, recursive=True) + "SELECT grp, sum(size)::BIGINT AS leaf_count, count(*) AS n_chunks, (SELECT hs[1] FROM t WHERE t.grp = c.grp AND len(hs) = 1) AS merkle_root FROM c GROUP BY grp")
def a17_manifest(spark, sf_dir):
    """A manifest for each session: members in chunks with hashes, and the root over these."""
    from palimpsest.operators.raptor import manifests

    return manifests(rec.episodes(spark, sf_dir).select(F.col("conv_id").alias("grp"), "id"), 2)


@query("m7_verify", with_(EPISODES) + "SELECT conv_id AS grp, conv_id % 4 <> 1 AS valid FROM episodes GROUP BY conv_id")
def m7_verify(spark, sf_dir):
    """M7: manifests against the members as they are now; some have lost one."""
    from palimpsest.operators.raptor import manifests, verify_manifests

    members = rec.episodes(spark, sf_dir).select(F.col("conv_id").alias("grp"), "id")
    before = members.unionByName(members.filter("grp % 4 = 1").select("grp", F.concat(F.lit("lost-"), "grp").alias("id")).distinct())
    return verify_manifests(manifests(before, 2), members, 2)


@query("m8_generations", with_(EPISODES, _MERKLE, recursive=True) + "SELECT grp, core AS generation_id, sha256('attempt|' || core || '|job-' || grp || '|' || (grp % 3)) AS attempt_id FROM (SELECT grp, sha256(concat_ws('|', 'generation', merkle_root, leaf_count, CASE WHEN grp % 2 = 0 THEN 'g0' ELSE '-' END, '1', 'tree-1', 'model-1')) AS core FROM (SELECT grp, sum(size)::BIGINT AS leaf_count, (SELECT hs[1] FROM t WHERE t.grp = c.grp AND len(hs) = 1) AS merkle_root FROM c GROUP BY grp))")
def m8_generations(spark, sf_dir):
    """M8: ids of generations by content and base, and of each fenced attempt at one."""
    from palimpsest.operators.raptor import generation_ids, manifests

    m = manifests(rec.episodes(spark, sf_dir).select(F.col("conv_id").alias("grp"), "id"), 2)
    base = F.when(F.col("grp") % 2 == 0, "g0")
    return generation_ids(m, base, F.lit("1"), "tree-1", "model-1", F.concat(F.lit("job-"), "grp"), F.col("grp") % 3).select("grp", "generation_id", "attempt_id")


@query("c16_evidence_digest", with_(OBSERVATIONS) + "SELECT state_key, sha256('[\"' || string_agg(DISTINCT evidence_id, '\",\"' ORDER BY evidence_id) || '\"]') AS digest FROM observations GROUP BY state_key")
def c16_evidence_digest(spark, sf_dir):
    """A hash of the sorted distinct evidence."""
    return rec.observations(spark, sf_dir).groupBy("state_key").agg(F.collect_set("evidence_id").alias("ids")).select("state_key", ident.evidence_digest(F.col("ids")).alias("digest"))


@query("u4_revocations", with_(POLICIES) + "SELECT residency, string_agg(DISTINCT d, ',' ORDER BY d) AS revoked FROM (SELECT residency, store_id AS d FROM policies UNION SELECT residency, embedding_id FROM policies) GROUP BY residency")
def u4_revocations(spark, sf_dir):
    """U4, ST11, AD3: revoked destinations as a sorted union."""
    p = rec.policies(spark, sf_dir)
    return p.groupBy("residency").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("store_id"), F.collect_set("embedding_id"))), ",").alias("revoked"))


@query("u5_edge_jaccard", "SELECT a.label AS a, b.label AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM (SELECT label, list(DISTINCT vec_id % 50) AS s FROM embeddings GROUP BY label) a JOIN (SELECT label, list(DISTINCT vec_id % 50) AS s FROM embeddings GROUP BY label) b ON a.label < b.label")
def u5_edge_jaccard(spark, sf_dir):
    """Overlap of two generations' edges; the sets of labels, of which there are few, pair by pair."""
    sets = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_set(F.col("vec_id") % 50).alias("s"))
    a, b = sets.select(F.col("label").alias("a"), F.col("s").alias("x")), sets.select(F.col("label").alias("b"), F.col("s").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))


@query("st4_ingest_partition", with_(EPISODES, TOMBSTONES) + f"SELECT CASE WHEN id IN (SELECT target_id FROM tombstones) THEN 'tombstoned' WHEN expires_at <= {NOW_MS + SKEW_MS} THEN 'expired' WHEN status <> 'active' OR secret_scan <> 'passed' THEN 'quarantined' ELSE 'delivered' END AS outcome, count(*) AS n FROM episodes GROUP BY 1")
def st4_ingest_partition(spark, sf_dir):
    """ST3, ST4, C11: what becomes of each arriving episode; the counts add up."""
    dead = rec.tombstones(spark, sf_dir).select(F.col("target_id").alias("id"), F.lit(True).alias("dead")).distinct()
    how = F.when(F.col("dead"), "tombstoned").when(F.col("expires_at") <= NOW_MS + SKEW_MS, "expired").when((F.col("status") != "active") | (F.col("secret_scan") != "passed"), "quarantined").otherwise("delivered")
    return rec.episodes(spark, sf_dir).join(dead, "id", "left").groupBy(how.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("x_rollup_daily", with_(OBSERVATIONS) + f"SELECT CAST((effective_at - {BASE_MS}) // {DAY_MS} AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM observations GROUP BY ROLLUP (1, 2)")
def x_rollup_daily(spark, sf_dir):
    """Beyond the inventory: daily totals by kind, rolled up."""
    day = F.floor((F.col("effective_at") - BASE_MS) / DAY_MS).cast("long").alias("day")
    return rec.observations(spark, sf_dir).rollup(day, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
