"""Memory search over all modes and projects, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import search as op
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, NOW_MS, SEARCH_RECORDS, SKEW_MS, table

CONFIG = op.SearchConfig(owner="alpha", now=NOW_MS, skew=SKEW_MS)

#: id, query, project, kind, mode, child, k, after, before, number of the vector that stands for the query.
REQUESTS = [(f"{mode}-p{p}-{kind[:3]}", "  The re ", f"p{p}", kind, mode, False, 5, None, None, p) for mode in op.MODES for p in range(5) for kind in ("registered", "local_only")] + [
    ("ten", "user did", "p0", "local_only", "curated", False, 99, None, None, 7),
    ("one", "the", "p0", "registered", "all", False, -3, None, None, 8),
    ("window", "the", "p0", "local_only", "all", False, 10, BASE_MS + 600_000, BASE_MS + 40_000_000, 9),
    ("no-vector", "the there", "p0", "local_only", "all", False, 10, None, None, None),
    ("terms", "ＴＨＥ there/", "p0", "local_only", "curated", False, 4, None, None, None),
    ("child", "the", "p0", "registered", "all", True, 5, None, None, 1),
    ("blank", "   ", "p0", "registered", "all", False, 5, None, None, 1),
    ("unknown-mode", "the", "p0", "registered", "everything", False, 5, None, None, 1),
    ("backwards", "the", "p0", "registered", "all", False, 5, NOW_MS, BASE_MS, 1),
    ("unregistered", "the", "p0", "none", "all", False, 5, None, None, 1),
    ("no-project", "the", None, "registered", "all", False, 5, None, None, 1),
]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(REQUESTS, "request_id string, query string, project_id string, project_kind string, mode string, is_child boolean, k int, after long, before long, vec long")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").cast("array<double>").alias("vector"))
    return op.with_terms(rows).join(vectors, "vec", "left").drop("vec")


def control(spark: SparkSession, **changed) -> DataFrame:
    row = {"owner_host": "alpha", "version": 3, "state": "active", "privacy_epoch": 1, "policy_epoch": 1, "policy_hash": "h1", "active_generation": "g1", "processing_policy_id": "pol0", "revoked": []} | changed
    return spark.createDataFrame([row], "owner_host string, version long, state string, privacy_epoch long, policy_epoch long, policy_hash string, active_generation string, processing_policy_id string, revoked array<string>")


def store(spark: SparkSession, sf_dir: str, **changed) -> op.Store:
    suppliers = table(spark, sf_dir, "supplier")
    policies = suppliers.select(
        F.concat(F.lit("pol"), F.col("s_suppkey") - 1).alias("policy_id"),
        F.lit("alpha").alias("owner_host"),
        F.lit(1).cast("long").alias("privacy_epoch"),
        F.lit("store").alias("store_id"),
        F.lit("embedding").alias("embedding_id"),
        F.when(F.col("s_suppkey") % 4 == 0, "other").otherwise("llm").alias("llm_id"),
        F.lit("eu").alias("residency"),
        F.lit("memory").alias("data_use"),
        F.when(F.col("s_suppkey") % 4 == 3, F.lit(BASE_MS)).alias("expires_at"),
    )
    forgotten = table(spark, sf_dir, "conversations").filter("conv_id % 5 = 1 AND turn = 1").select(F.concat(F.lit("ep-"), "conv_id", F.lit("-1")).alias("target_id"))
    states = table(spark, sf_dir, "events").filter("user_id % 50 = 11").select(F.concat(F.lit("state:"), "user_id").alias("target_id")).distinct()
    return op.Store(rec.search_records(spark, sf_dir), policies, forgotten.unionByName(states), control(spark), control(spark, **changed) if changed else None)


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


_IN_WINDOW = "(q.after IS NULL OR {0} >= q.after) AND (q.before IS NULL OR {0} <= q.before)"
_SCOPED = "r.policy_epoch = 1 AND ((s.reach = 'project' AND r.scope = 'project' AND r.project_id = q.project_id) OR (s.reach = 'global' AND r.scope = 'global'))"
_DENSE = "round(list_dot_product(r.vector, q.vector), 6)"
_HOLDS = "len(q.terms) > 0 AND len(list_filter(q.terms, lambda t: NOT contains(lower(nfc_normalize({0})), t))) = 0"
_WIDE = "len(list_filter(q.terms, lambda t: contains(lower(r.text), t) OR coalesce(r.tool_name, '') = t)) > 0"
_EXACT_TEXT = "CASE r.record_type WHEN 'episode' THEN concat_ws(' ', r.text, r.tool_name, r.tool_args, r.error_fingerprint) WHEN 'curated_memory' THEN concat_ws(' ', r.text, r.subject, r.predicate, r.value) WHEN 'curated_current' THEN CASE WHEN r.resolution = 'resolved' THEN r.text ELSE '' END ELSE '' END"
_BOUND = f"(expires_at IS NULL OR expires_at > {NOW_MS + SKEW_MS})"


def _lane(place: int, lane: str, types: str, keep: str, time: str, reaches: str) -> str:
    """A dense lane: the best twenty of each reach."""
    modes = ", ".join(f"'{m}'" for m, lanes in op.MODES.items() if lane in lanes)
    return f"""SELECT * FROM (
  SELECT q.request_id, '{lane}' AS lane, {place} AS place, {_DENSE} AS raw, r.*, row_number() OVER (PARTITION BY q.request_id, s.reach ORDER BY {_DENSE} DESC, r.id) AS seen
  FROM guarded r, q, s WHERE q.mode IN ({modes}) AND q.vector IS NOT NULL AND r.vector IS NOT NULL AND r.record_type IN ({types}) AND s.reach IN ({reaches}) AND (s.reach <> 'global' OR q.everywhere) AND {keep} AND {_IN_WINDOW.format(time)})
  WHERE seen <= 20 AND raw >= 0.35"""


_VALUES = ", ".join("(" + ", ".join(map(_sql, [*r[:2], r[2], *r[3:]])) + ")" for r in REQUESTS)
_DENSE_LANES = " UNION ALL ".join(
    [
        _lane(1, "current", "'curated_current'", _SCOPED, "r.created_at", "'project', 'global'"),
        _lane(2, "historical", "'curated_memory'", _SCOPED, "r.happened_at", "'project', 'global'"),
        _lane(3, "episodes", "'episode'", "r.project_id = q.project_id", "r.happened_at", "'project'"),
        _lane(4, "curated", "'curated_memory', 'curated_current'", _SCOPED, "r.created_at", "'project', 'global'"),
        _lane(5, "raptor", "'raptor_summary'", "r.policy_epoch = 1 AND list_contains(r.covered_projects, q.project_id) AND r.generation_id = 'g1'", "r.happened_at", "'project'"),
    ]
)
_COLUMNS = "id, record_type, happened_at, project_id, scope, policy_epoch, policy_hash, processing_policy_id, expires_at, text, event_kind, tool_name, resolution, content_id, observation_id, state_key, evidence_ids, member_ids, covered_projects"
_GOOD = "llm_id = 'llm' AND (expires_at IS NULL OR expires_at > 0)"
ORACLE = f"""
WITH RECURSIVE {SEARCH_RECORDS.strip()},
given(request_id, query, project_id, project_kind, mode, is_child, k, after, before, vec) AS (VALUES {_VALUES}),
q AS (
  SELECT g.*, v.vector, list_filter(regexp_split_to_array(lower(CASE WHEN request_id = 'terms' THEN 'the there/' ELSE trim(query) END), '[^a-z0-9._:/-]+'), lambda t: t <> '') AS terms, project_kind = 'registered' AND NOT is_child AS everywhere
  FROM given g LEFT JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings) v ON v.vec_id = g.vec
  WHERE length(trim(query)) BETWEEN 1 AND 4000 AND project_id IS NOT NULL AND project_kind IN ('registered', 'local_only') AND mode IN ({', '.join(f"'{m}'" for m in op.MODES)}) AND NOT is_child AND coalesce(after <= before, true)),
s(reach) AS (VALUES ('project'), ('global')),
guarded AS MATERIALIZED (SELECT * FROM records WHERE owner_host = 'alpha' AND status = 'active' AND secret_scan = 'passed' AND privacy_epoch = 1 AND {_BOUND}),
pol AS (
  SELECT 'pol' || (s_suppkey - 1) AS policy_id, s_suppkey % 4 <> 0 AND s_suppkey % 4 <> 3 AS good FROM supplier),
exact AS MATERIALIZED (
  SELECT request_id, 'exact' AS lane, 0 AS place, 1.0::DOUBLE AS raw, {_COLUMNS} FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, reach ORDER BY id) AS n FROM (
      SELECT q.request_id, q.terms, s.reach, r.*
      FROM guarded r, q, s
      WHERE (CASE q.mode WHEN 'all' THEN r.record_type <> 'raptor_summary' WHEN 'curated' THEN r.record_type LIKE 'curated%' WHEN 'episodes' THEN r.record_type = 'episode' ELSE false END)
        AND ((s.reach = 'project' AND r.project_id = q.project_id AND r.record_type <> 'raptor_summary') OR (s.reach = 'global' AND r.scope = 'global' AND q.everywhere)) AND {_IN_WINDOW.format('r.created_at')} AND {_WIDE}) r
    WHERE {_HOLDS.format(_EXACT_TEXT).replace('q.terms', 'terms')}) WHERE n <= 20),
dense AS MATERIALIZED (SELECT request_id, lane, place, raw, {_COLUMNS} FROM ({_DENSE_LANES})),
shown AS (
  SELECT h.*, CASE WHEN h.record_type = 'episode' THEN list_value(h.id) ELSE h.evidence_ids END AS ev, CASE WHEN h.record_type = 'episode' THEN 'project' ELSE h.scope END AS own_scope FROM (SELECT * FROM exact UNION ALL SELECT * FROM dense) h),
usable AS MATERIALIZED (
  SELECT h.* EXCLUDE (text), q.everywhere, q.k, q.mode, q.project_id AS asked, CASE WHEN h.record_type <> 'episode' OR trim(h.text) <> '' THEN h.text WHEN h.tool_name IS NOT NULL THEN 'Tool: ' || h.tool_name ELSE 'Memory event: ' || h.event_kind END AS text
  FROM shown h JOIN q USING (request_id)
  WHERE NOT (h.record_type = 'curated_current' AND h.resolution <> 'resolved') AND len(ev) > 0 AND (h.lane = 'exact' OR h.record_type = 'episode' OR (h.policy_epoch = 1 AND h.policy_hash = 'h1'))
    AND ((own_scope = 'project' AND h.project_id = q.project_id) OR (own_scope = 'global' AND q.everywhere)) AND h.record_type <> 'raptor_summary'),
may_embed AS (
  SELECT q.request_id FROM q WHERE (SELECT good FROM pol WHERE policy_id = 'pol0')
    AND NOT EXISTS (SELECT 1 FROM usable u LEFT JOIN pol p ON p.policy_id = u.processing_policy_id WHERE u.request_id = q.request_id AND u.lane = 'exact' AND NOT coalesce(p.good, false))),
seeds AS (
  SELECT d.* FROM dense d JOIN q USING (request_id) WHERE d.lane = 'raptor' AND request_id IN (SELECT request_id FROM may_embed) AND d.policy_hash = 'h1' AND d.covered_projects = list_value(q.project_id) AND len(d.member_ids) BETWEEN 1 AND 1024),
below AS (
  SELECT request_id, raw, processing_policy_id AS way, unnest(member_ids) AS id, 1 AS depth FROM seeds
  UNION SELECT b.request_id, b.raw, r.processing_policy_id, r.m, b.depth + 1 FROM below b JOIN (SELECT id, processing_policy_id, unnest(member_ids) AS m FROM records WHERE record_type = 'raptor_summary') r ON r.id = b.id WHERE b.depth <= 10),
ways AS (
  SELECT request_id, raw, unnest(member_ids) AS id, [processing_policy_id] AS path FROM seeds
  UNION SELECT w.request_id, w.raw, r.m, list_sort(list_distinct(list_append(w.path, r.processing_policy_id))) FROM ways w JOIN (SELECT id, processing_policy_id, unnest(member_ids) AS m FROM records WHERE record_type = 'raptor_summary') r ON r.id = w.id),
reached AS MATERIALIZED (
  SELECT b.*, w.path FROM (SELECT request_id, id, max(raw) AS raw, min(depth) AS depth FROM below GROUP BY request_id, id) b
  JOIN (SELECT request_id, id, list_distinct(flatten(list(path))) AS path FROM ways GROUP BY request_id, id) w USING (request_id, id)),
failed AS (
  SELECT DISTINCT b.request_id FROM reached b JOIN q USING (request_id) LEFT JOIN records r USING (id)
  WHERE r.id IS NULL OR r.owner_host <> 'alpha' OR r.privacy_epoch <> 1 OR NOT (r.expires_at IS NULL OR r.expires_at > {NOW_MS + SKEW_MS})
    OR CASE r.record_type WHEN 'raptor_summary' THEN r.generation_id <> 'g1' OR r.policy_epoch <> 1 OR r.policy_hash <> 'h1' OR NOT list_contains(r.covered_projects, q.project_id)
       WHEN 'episode' THEN r.project_id <> q.project_id OR r.status <> 'active' OR r.secret_scan <> 'passed' ELSE r.policy_epoch <> 1 OR r.policy_hash <> 'h1' END),
leaves AS (
  SELECT b.request_id, 'raptor' AS lane, 5 AS place, b.raw, r.id, r.record_type, r.happened_at, r.project_id, r.processing_policy_id, r.content_id, r.observation_id, r.state_key, list_value(r.id) AS ev, 'project' AS own_scope, r.policy_epoch, r.expires_at, q.everywhere, q.k, q.mode, q.project_id AS asked,
    CASE WHEN trim(r.text) <> '' THEN r.text WHEN r.tool_name IS NOT NULL THEN 'Tool: ' || r.tool_name ELSE 'Memory event: ' || r.event_kind END AS text, b.path
  FROM reached b JOIN records r USING (id) JOIN q USING (request_id) WHERE r.record_type = 'episode'),
lanes AS MATERIALIZED (
  SELECT request_id, lane, place, raw, id, record_type, happened_at, project_id, processing_policy_id, content_id, observation_id, state_key, ev, own_scope, policy_epoch, expires_at, everywhere, k, mode, asked, text, CAST([] AS VARCHAR[]) AS path FROM usable WHERE lane = 'exact' OR request_id IN (SELECT request_id FROM may_embed)
  UNION ALL SELECT * FROM leaves),
changed AS (
  SELECT * FROM (SELECT *, lag(content_id) OVER w AS prior FROM lanes WINDOW w AS (PARTITION BY request_id, lane, policy_epoch, state_key, own_scope, project_id ORDER BY happened_at, id)) WHERE lane <> 'historical' OR prior IS NULL OR prior <> content_id),
timed AS (SELECT *, CASE WHEN record_type = 'curated_memory' THEN happened_at END AS valid_from, CASE WHEN lane = 'historical' THEN lead(happened_at) OVER (PARTITION BY request_id, lane, policy_epoch, state_key, own_scope, project_id ORDER BY happened_at, id) END AS valid_to FROM changed),
shares AS (
  SELECT *, 1.0 / (60 + row_number() OVER (PARTITION BY request_id, lane ORDER BY raw DESC, id)) + CASE WHEN project_id IS NOT NULL THEN 0.05 ELSE 0 END AS share,
    CASE WHEN lane = 'historical' AND observation_id IS NOT NULL THEN 'o' || observation_id WHEN content_id IS NOT NULL THEN 'c' || content_id ELSE 'e' || array_to_string(list_sort(ev), '|') END AS key FROM timed),
summed AS (SELECT request_id, id, round(sum(share), 9)::DOUBLE AS score, min(place) AS place FROM shares GROUP BY request_id, id),
first AS (SELECT s.score, h.* FROM summed s JOIN (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY place) AS one FROM shares) h ON h.request_id = s.request_id AND h.id = s.id AND h.one = 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS p FROM (SELECT *, row_number() OVER (PARTITION BY request_id, key ORDER BY score DESC, id) AS n FROM first) WHERE n = 1) WHERE p <= greatest(1, least(10, k)) AND request_id NOT IN (SELECT request_id FROM failed)),
proof AS (SELECT b.request_id, b.id, b.own_scope, b.asked, unnest(b.ev) AS e FROM best b WHERE record_type <> 'episode'),
found AS (SELECT p.*, r.processing_policy_id AS policy, NOT (r.owner_host = 'alpha' AND r.privacy_epoch = 1 AND r.status = 'active' AND r.secret_scan = 'passed' AND (r.expires_at IS NULL OR r.expires_at > {NOW_MS + SKEW_MS}) AND CASE p.own_scope WHEN 'global' THEN r.project_kind = 'registered' ELSE r.project_id = p.asked END) AS bad
  FROM proof p JOIN records r ON r.id = p.e AND r.record_type = 'episode'),
held AS (SELECT b.*, record_type = 'episode' OR (SELECT count(*) FROM found f WHERE f.request_id = b.request_id AND f.id = b.id) = len(ev) AS alive FROM best b WHERE request_id NOT IN (SELECT request_id FROM found WHERE bad)),
bound AS (
  SELECT request_id, id, unnest(list_append(path, processing_policy_id)) AS policy FROM held WHERE alive
  UNION SELECT request_id, id, policy FROM found WHERE request_id IN (SELECT request_id FROM held)),
allowed AS (
  SELECT * FROM held h WHERE alive AND {_BOUND} AND request_id NOT IN (SELECT request_id FROM bound WHERE policy NOT IN (SELECT policy_id FROM pol))
    AND NOT EXISTS (SELECT 1 FROM bound b JOIN pol p ON p.policy_id = b.policy WHERE b.request_id = h.request_id AND b.id = h.id AND NOT p.good)),
gone AS (SELECT 'ep-' || conv_id || '-1' AS target FROM conversations WHERE conv_id % 5 = 1 AND turn = 1 UNION SELECT 'state:' || user_id FROM events WHERE user_id % 50 = 11),
buried AS (SELECT request_id FROM allowed WHERE id IN (FROM gone) OR state_key IN (FROM gone) UNION SELECT request_id FROM (SELECT request_id, unnest(ev) AS e FROM allowed) WHERE e IN (FROM gone))
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN mode = 'historical' THEN valid_from END, CASE WHEN mode <> 'historical' THEN -score END, id) AS position, id, record_type, lane, score, text, valid_from, valid_to
FROM allowed WHERE request_id NOT IN (FROM buried)"""


@query("memory_search", ORACLE)
def memory_search(spark, sf_dir):
    """§2.12, Q-notes 1 to 9: all modes, projects and identities, by the whole search."""
    return op.search(store(spark, sf_dir), requests(spark, sf_dir), CONFIG)
