"""Guards, predicates and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import retrieval as op
from palimpsest.plans.registry import query
from palimpsest.plans.retrieval import GUARD
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, DAY_MS, EPISODES, NOW_MS, OBSERVATIONS, POLICIES, SKEW_MS, table, with_


@query("f1_episode_lane", with_(EPISODES) + f"SELECT id, event_at FROM episodes WHERE {GUARD} AND project_id = 'p2' AND event_at >= {BASE_MS} AND event_at <= {BASE_MS + 2 * DAY_MS}")
def f1_episode_lane(spark, sf_dir):
    """the episode lane's mandatory filter with a time window."""
    keep = op.lane_filter("episodes", "alpha", "p2", 1, NOW_MS, SKEW_MS, after=BASE_MS, before=BASE_MS + 2 * DAY_MS)
    return rec.episodes(spark, sf_dir).filter(keep).select("id", "event_at")


@query("f2_historical_lanes", with_(OBSERVATIONS) + "SELECT id, scope FROM observations WHERE policy_epoch = 1 AND (scope = 'global' OR (scope = 'project' AND project_id = 'p1'))")
def f2_historical_lanes(spark, sf_dir):
    """The historical lane of one project, and the global one."""
    obs = rec.observations(spark, sf_dir).withColumns({"owner_host": F.lit("alpha"), "status": F.lit("active"), "secret_scan": F.lit("passed"), "privacy_epoch": F.lit(1), "expires_at": F.lit(None).cast("long")})
    own = obs.filter(op.lane_filter("historical", "alpha", "p1", 1, NOW_MS, SKEW_MS))
    everywhere = obs.filter(op.lane_filter("historical", "alpha", "p1", 1, NOW_MS, SKEW_MS, is_global=True))
    return own.unionByName(everywhere).select("id", "scope")


@query("f4_raptor_lane", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 4 IN (1, 2) AND o_orderkey % 3 = 1")
def f4_raptor_lane(spark, sf_dir):
    """summaries of the active generation that cover the project."""
    summaries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("p"), F.col("o_custkey") % 4), F.concat(F.lit("p"), (F.col("o_custkey") + 3) % 4)).alias("covered_projects"), F.concat(F.lit("g"), F.col("o_orderkey") % 3).alias("generation_id"), F.lit("alpha").alias("owner_host"), F.lit("active").alias("status"), F.lit("passed").alias("secret_scan"), F.lit(1).alias("privacy_epoch"), F.lit(1).alias("policy_epoch"), F.lit(None).cast("long").alias("expires_at"))
    return summaries.filter(op.lane_filter("raptor", "alpha", "p1", 1, NOW_MS, SKEW_MS, generation="g1")).select("id")


@query("f7_predicate_tree", with_(EPISODES) + f"SELECT id FROM episodes WHERE event_kind IN ('user', 'assistant') AND event_at > {BASE_MS + 1000} AND coalesce(project_id, '') <> 'p3' AND (tool_name = 'tool1' OR expires_at IS NULL)")
def f7_predicate_tree(spark, sf_dir):
    """a condition tree compiled to one expression."""
    spec = {"must": [{"key": "event_kind", "match": ["user", "assistant"]}, {"key": "event_at", "range": {"gt": BASE_MS + 1000}}], "must_not": [{"key": "project_id", "match": "p3"}], "should": [{"key": "tool_name", "match": "tool1"}, {"is_null": "expires_at"}]}
    return rec.episodes(spark, sf_dir).filter(op.predicate(spec)).select("id")


@query("f8_exact_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')")
def f8_exact_terms(spark, sf_dir):
    """Documents that hold every term of a query."""
    return table(spark, sf_dir, "documents").filter(op.contains_terms(F.col("text"), op.exact_terms("The, OF!"))).select("doc_id")


_RECORDS = """
records AS (SELECT 'episode' AS record_type, id, text, tool_name, CASE WHEN turn % 4 = 3 THEN '{"n":' || turn || '}' END AS tool_args, CASE WHEN turn % 8 = 7 THEN left(sha256(text), 32) END AS error_fingerprint, CAST(NULL AS VARCHAR) AS subject FROM episodes
  UNION ALL SELECT 'curated_memory', id, 'state of tool1 is ' || event_type, NULL, NULL, NULL, 'User ' || user_id FROM observations)"""


@query("f9_exact_prefilter", with_(EPISODES, OBSERVATIONS, _RECORDS) + "SELECT id, record_type FROM (SELECT * FROM records WHERE contains(lower(text), 'tool1') OR contains(lower(text), 'user') OR tool_name IN ('tool1', 'user') OR error_fingerprint IN ('tool1', 'user') ORDER BY id LIMIT 1024) WHERE contains(lower(concat_ws(' ', text, tool_name, tool_args, error_fingerprint, subject)), 'tool1') AND contains(lower(concat_ws(' ', text, tool_name, tool_args, error_fingerprint, subject)), 'user') ORDER BY id LIMIT 100")
def f9_exact_prefilter(spark, sf_dir):
    """The exact lane: a bounded scan of what may match, then every term in the record's text."""
    none = F.lit(None).cast("string")
    turn = F.col("turn")
    ep = rec.episodes(spark, sf_dir).select(F.lit("episode").alias("record_type"), "id", "text", "tool_name", F.when(turn % 4 == 3, F.concat(F.lit('{"n":'), turn, F.lit("}"))).alias("tool_args"), F.when(turn % 8 == 7, F.left(F.sha2("text", 256), F.lit(32))).alias("error_fingerprint"), none.alias("subject"))
    obs = rec.observations(spark, sf_dir).select(F.lit("curated_memory").alias("record_type"), "id", F.concat(F.lit("state of tool1 is "), "event_type").alias("text"), none.alias("tool_name"), none.alias("tool_args"), none.alias("error_fingerprint"), F.concat(F.lit("User "), "user_id").alias("subject"))
    records = ep.unionByName(obs).withColumns({"predicate": none, "value": none, "resolution": none})
    return op.exact_lane(records, "TOOL1, user!", 100).select("id", "record_type")


@query("f14_project_rules", with_(EPISODES) + "SELECT id, project_id IS NULL OR project_id <> 'p3' AS open_rule, coalesce(project_id IN ('p1', 'p2', 'p3') AND project_id <> 'p3', false) AS closed_rule FROM episodes")
def f14_project_rules(spark, sf_dir):
    """denied projects never pass; a list of allowed ones needs a project on it, no list needs none."""
    from palimpsest.operators.capture import allowed_project

    return rec.episodes(spark, sf_dir).select("id", allowed_project([], ["p3"]).alias("open_rule"), allowed_project(["p1", "p2", "p3"], ["p3"]).alias("closed_rule"))


_GOOD = f"coalesce(residency = 'eu' AND data_use = 'memory' AND store_id = 'store0' AND embedding_id = 'embed0' AND llm_id = 'llm0' AND (p.expires_at IS NULL OR p.expires_at > {BASE_MS + SKEW_MS}), false)"


@query("f16_destinations", with_(EPISODES, POLICIES) + f"SELECT policy_id, {_GOOD} AS authorised, (SELECT count(*) FROM episodes e WHERE e.processing_policy_id = p.policy_id) AS n_records FROM policies p")
def f16_destinations(spark, sf_dir):
    """Which policies authorise a set of destinations, and how many records each governs."""
    p = rec.policies(spark, sf_dir)
    own = p.select("policy_id", F.col("policy_id").alias("processing_policy_id"))
    good = op.authorised(own, p, BASE_MS, SKEW_MS, _DESTINATIONS, "eu", "memory").select("policy_id", F.lit(True).alias("g"))
    held = rec.episodes(spark, sf_dir).groupBy(F.col("processing_policy_id").alias("policy_id")).agg(F.count(F.lit(1)).alias("n"))
    return p.join(good, "policy_id", "left").join(held, "policy_id", "left").select("policy_id", F.coalesce("g", F.lit(False)).alias("authorised"), F.coalesce("n", F.lit(0)).alias("n_records"))


_DESTINATIONS = {"store_id": "store0", "embedding_id": "embed0", "llm_id": "llm0"}


@query("j3_authorisation", with_(EPISODES, POLICIES) + f"SELECT e.id FROM episodes e JOIN policies p ON e.processing_policy_id = p.policy_id AND policy_id <> 'pol3' WHERE residency = 'eu' AND data_use = 'memory' AND (p.expires_at IS NULL OR p.expires_at > {BASE_MS + SKEW_MS}) AND NOT EXISTS (SELECT 1 FROM episodes x WHERE x.project_id = e.project_id AND x.processing_policy_id = 'pol3' AND x.conv_id % 20 = 3) AND e.conv_id % 20 <> 7 AND (e.processing_policy_id <> 'pol3' OR e.conv_id % 20 = 3) AND project_id IS NOT NULL")
def j3_authorisation(spark, sf_dir):
    """Candidates by the labels of their policies; an answer (here a project) with a missing policy is empty."""
    policies = rec.policies(spark, sf_dir).filter("policy_id <> 'pol3'")
    found = rec.episodes(spark, sf_dir).filter("(processing_policy_id <> 'pol3' OR conv_id % 20 = 3) AND conv_id % 20 <> 7 AND project_id IS NOT NULL")
    return op.authorised(found, policies, BASE_MS, SKEW_MS, {}, "eu", "memory", answer="project_id").select("id")


@query("f17_secret_ids", "SELECT url, regexp_matches(url, '(?i)(api[-_]?key|access[-_]?token|auth(?:orization|entication)?|bearer|credential|password|secret|token)') AS suspicious FROM (SELECT CASE WHEN page_id % 9 = 1 THEN url || '/auth-' || page_id WHEN page_id % 9 = 2 THEN url || '?Api_Key=1' WHEN page_id % 9 = 3 THEN url || '/authority' ELSE url END AS url FROM pages)")
def f17_secret_ids(spark, sf_dir):
    """identifiers that look like secrets."""
    from palimpsest.functions.secrets import SECRET_ID

    k = F.col("page_id") % 9
    url = F.concat("url", F.when(k == 1, F.concat(F.lit("/auth-"), "page_id")).when(k == 2, "?Api_Key=1").when(k == 3, "/authority").otherwise(""))
    return table(spark, sf_dir, "pages").select(url.alias("url")).withColumn("suspicious", F.col("url").rlike(SECRET_ID))


@query("f19_prompts", with_(EPISODES) + "SELECT id FROM episodes WHERE trim(text) <> '' AND left(ltrim(text), 1) <> '/' AND event_kind = 'user'")
def f19_prompts(spark, sf_dir):
    """natural-language prompts."""
    return rec.episodes(spark, sf_dir).filter(tx.is_prompt(F.col("text")) & (F.col("event_kind") == "user")).select("id")


_BOUNDS = {
    "event_id": "event_id",
    "after": "CASE event_id % 11 WHEN 0 THEN '2024-01-1' || (event_id % 10) || 'T10:30:00-04:00' WHEN 1 THEN '2024-01-05T16:00:00.123456789Z' WHEN 2 THEN '2024-02-30T15:00:00Z' WHEN 3 THEN '2024-01-05T25:00:00Z' WHEN 4 THEN '2024-01-05T15:00:00+25:00' WHEN 5 THEN '2024-01-05' WHEN 6 THEN '2024-01-05T15:00:00' WHEN 7 THEN '2024-01-05T15:00:60Z' WHEN 8 THEN '2024-01-05T15:00:00.5+05:30' WHEN 9 THEN NULL ELSE '2024-02-29T23:59:59.99Z' END",
    "before": "CASE WHEN event_id % 4 = 0 THEN '2024-01-12T00:00:00Z' WHEN event_id % 4 = 1 THEN '2024-03-01T00:00:00+01:00' WHEN event_id % 4 = 2 THEN NULL ELSE '2024-01-06T00:00:00Z' END",
}
_PARSED = """
m AS (SELECT event_id, side, s, regexp_extract(s, '^(\\d{4}-\\d{2}-\\d{2})T(\\d{2}):(\\d{2}):(\\d{2})(?:\\.(\\d{1,9}))?(Z|[+-]\\d{2}:\\d{2})$', ['d', 'h', 'm', 's', 'f', 'z']) AS p FROM (SELECT event_id, 'after' AS side, "after" AS s FROM b UNION ALL SELECT event_id, 'before', "before" FROM b)),
i AS (SELECT event_id, side, s, CASE WHEN p.z <> '' AND try_cast(p.d AS DATE) IS NOT NULL AND try_cast(p.h AS INT) < 24 AND try_cast(p.m AS INT) < 60 AND try_cast(p.s AS INT) < 60 AND (p.z = 'Z' OR (try_cast(p.z[2:3] AS INT) < 24 AND try_cast(p.z[5:6] AS INT) < 60)) THEN
  CAST(epoch_ms(CAST(try_cast(p.d AS DATE) AS TIMESTAMP)) + (try_cast(p.h AS BIGINT) * 3600 + try_cast(p.m AS BIGINT) * 60 + try_cast(p.s AS BIGINT)) * 1000 + try_cast(left(p.f || '000', 3) AS BIGINT) - CASE WHEN p.z = 'Z' THEN 0 ELSE (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (try_cast(p.z[2:3] AS BIGINT) * 60 + try_cast(p.z[5:6] AS BIGINT)) * 60000 END AS BIGINT) END AS ms FROM m)"""


@query("f20_window_parse", with_(rec.cte("b", "events", {k: v for k, v in (("event_id", _BOUNDS["event_id"]), ('"after"', _BOUNDS["after"]), ('"before"', _BOUNDS["before"]))}), _PARSED) + """
SELECT event_id, a.ms AS after_ms, z.ms AS before_ms, CASE WHEN (a.s IS NOT NULL AND a.ms IS NULL) OR (z.s IS NOT NULL AND z.ms IS NULL) THEN 'bound' WHEN a.ms > z.ms THEN 'window' ELSE 'valid' END AS verdict,
  CASE WHEN a.ms IS NOT NULL THEN strftime(make_timestamp(a.ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS after
FROM (SELECT * FROM i WHERE side = 'after') a JOIN (SELECT * FROM i WHERE side = 'before') z USING (event_id)""")
def f20_window_parse(spark, sf_dir):
    """Strict time bounds as users write them, to milliseconds and back to canonical text."""
    from palimpsest.functions import instants as it

    b = rec.derived(spark, sf_dir, "events", _BOUNDS)
    w = it.window(F.col("after"), F.col("before"))
    return b.withColumn("w", w).select("event_id", "w.after_ms", "w.before_ms", "w.verdict", it.canonical(F.col("w.after_ms")).alias("after"))


_SCORED = """
records AS (SELECT 'episode' AS record_type, id, CASE WHEN turn % 6 = 5 THEN ' ' WHEN turn % 6 = 4 THEN repeat('z', 16001) ELSE text END AS text, CASE WHEN turn % 12 = 5 THEN NULL ELSE tool_name END AS tool_name, event_kind, CAST(NULL AS VARCHAR) AS resolution, CASE WHEN conv_id % 9 = 2 THEN 'NaN'::DOUBLE ELSE 0.5 END AS score, CAST(NULL AS VARCHAR[]) AS evidence_ids FROM episodes
  UNION ALL SELECT 'curated_current', id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END, NULL, NULL, CASE WHEN event_id % 5 = 0 THEN 'conflict' ELSE 'resolved' END, value, CASE WHEN event_id % 11 = 0 THEN CAST([] AS VARCHAR[]) WHEN event_id % 11 = 1 THEN [evidence_id, evidence_id] ELSE [evidence_id, 'x'] END FROM observations)"""


@query("p4_candidates", with_(EPISODES, OBSERVATIONS, _SCORED) + """
SELECT id, record_type, length(shown) AS n_chars, len(evidence) AS n_evidence FROM (SELECT *, CASE WHEN record_type <> 'episode' THEN text WHEN trim(text) <> '' THEN text WHEN tool_name IS NOT NULL THEN 'Tool: ' || tool_name ELSE 'Memory event: ' || event_kind END AS shown,
  CASE WHEN record_type = 'episode' THEN [id] ELSE evidence_ids END AS evidence FROM records)
WHERE coalesce(resolution, 'resolved') = 'resolved' AND trim(shown) <> '' AND length(shown) <= 16000 AND NOT isnan(score) AND len(evidence) > 0 AND len(list_distinct(evidence)) = len(evidence)""")
def p4_candidates(spark, sf_dir):
    """Records as candidates; conflicts, blank and oversized texts, bad scores and bad evidence go."""
    turn, none = F.col("turn"), F.lit(None).cast("string")
    text = F.when(turn % 6 == 5, " ").when(turn % 6 == 4, F.repeat(F.lit("z"), 16_001)).otherwise(F.col("text"))
    ep = rec.episodes(spark, sf_dir).select(F.lit("episode").alias("record_type"), "id", text.alias("text"), F.when(turn % 12 != 5, F.col("tool_name")).alias("tool_name"), "event_kind", none.alias("resolution"), F.when(F.col("conv_id") % 9 == 2, float("nan")).otherwise(0.5).alias("score"), F.lit(None).cast("array<string>").alias("evidence_ids"))
    k, e = F.col("event_id"), F.col("evidence_id")
    evidence = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 11 == 1, F.array(e, e)).otherwise(F.array(e, F.lit("x")))
    cur = rec.observations(spark, sf_dir).select(F.lit("curated_current").alias("record_type"), "id", F.when(k % 7 == 0, "").otherwise(F.col("event_type")).alias("text"), none.alias("tool_name"), none.alias("event_kind"), F.when(k % 5 == 0, "conflict").otherwise("resolved").alias("resolution"), F.col("value").alias("score"), evidence.alias("evidence_ids"))
    return op.candidates(ep.unionByName(cur)).select("id", "record_type", F.length("text").cast("long").alias("n_chars"), F.size("evidence_ids").cast("long").alias("n_evidence"))


@query("p6_curation_text", with_(OBSERVATIONS) + "SELECT state_key, concat_ws(chr(10), 'category:fact', 'scope:' || any_value(scope), 'subject:' || state_key, 'predicate:is', 'value:\"' || min(event_type) || '\"', 'evidence:' || string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id)) AS text FROM observations GROUP BY state_key")
def p6_curation_text(spark, sf_dir):
    """The text of a curated item, field by field, with its evidence sorted."""
    line = lambda label, c: F.concat(F.lit(f"{label}:"), c)
    items = rec.observations(spark, sf_dir).groupBy("state_key").agg(F.first("scope").alias("scope"), F.min("event_type").alias("v"), F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("e"))
    return items.select("state_key", F.concat_ws("\n", F.lit("category:fact"), line("scope", "scope"), line("subject", "state_key"), F.lit("predicate:is"), F.concat(F.lit('value:"'), "v", F.lit('"')), line("evidence", "e")).alias("text"))


@query("p7_item_scope", with_(EPISODES, OBSERVATIONS, """
i AS (SELECT event_id AS item, CASE event_id % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'session' ELSE 'global' END AS scope, unnest([evidence_id, CASE WHEN event_id % 2 = 0 THEN evidence_id ELSE 'ep-' || (event_id % 90) || '-1' END]) AS e FROM observations),
p AS (SELECT item, any_value(scope) AS scope, bool_or(x.id IS NULL) AS lost, count(DISTINCT coalesce(project_id, '')) AS np, count(DISTINCT session_id) AS ns, min(project_id) AS project_id, arg_max(x.id, (event_at, x.id)) AS primary_id, max(event_at) AS event_at FROM i LEFT JOIN episodes x ON x.id = i.e GROUP BY item)""") + """
SELECT item, CASE WHEN lost THEN 'evidence is missing' WHEN scope = 'project' AND np <> 1 THEN 'several projects' WHEN scope = 'session' AND ns <> 1 THEN 'several sessions' END AS error,
  CASE WHEN NOT lost AND scope = 'project' AND np = 1 THEN project_id END AS project_id, CASE WHEN NOT (lost OR (scope = 'project' AND np <> 1) OR (scope = 'session' AND ns <> 1)) THEN primary_id END AS primary_id FROM p""")
def p7_item_scope(spark, sf_dir):
    """Curated items projected on their evidence, which must resolve and agree with the item's scope."""
    from palimpsest.operators.temporal import project_items

    k = F.col("event_id")
    scope = F.when(k % 3 == 0, "project").when(k % 3 == 1, "session").otherwise("global")
    second = F.when(k % 2 == 0, F.col("evidence_id")).otherwise(F.concat(F.lit("ep-"), k % 90, F.lit("-1")))
    items = rec.observations(spark, sf_dir).select(k.alias("item"), scope.alias("scope"), F.array("evidence_id", second).alias("evidence_ids"))
    return project_items(items, rec.episodes(spark, sf_dir)).select("item", "error", "project_id", "primary_id")


@query("p9_effective_episode", with_(EPISODES, POLICIES) + f"SELECT id, e.processing_policy_id AS origin_policy, 'polX' AS processing_policy_id, least(coalesce(e.expires_at, {NOW_MS}), {NOW_MS}) AS expires_at, 'store9' AS destination_id, origin AS origin_provider FROM episodes e LEFT JOIN policies p ON p.policy_id = e.processing_policy_id")
def p9_effective_episode(spark, sf_dir):
    """Episodes re-stamped with the worker's policy, expiry and destination; where they came from stays."""
    p = rec.policies(spark, sf_dir).select(F.col("policy_id").alias("processing_policy_id"), F.col("origin").alias("origin_provider"))
    return op.effective(rec.episodes(spark, sf_dir).join(p, "processing_policy_id", "left"), "polX", NOW_MS, "store9").select("id", "origin_policy", "processing_policy_id", "expires_at", "destination_id", "origin_provider")


@query("p10_retention", with_(EPISODES) + f"SELECT id, CASE WHEN conv_id % 2 = 0 THEN event_at + {30 * DAY_MS} END AS expires_at, greatest(1, least(10, turn * 3)) AS top_k FROM episodes")
def p10_retention(spark, sf_dir):
    """Expiry from retention days, and a clamped limit."""
    return rec.episodes(spark, sf_dir).select("id", F.when(F.col("conv_id") % 2 == 0, F.col("event_at") + 30 * DAY_MS).alias("expires_at"), F.greatest(F.lit(1), F.least(F.lit(10), F.col("turn") * 3)).cast("long").alias("top_k"))
