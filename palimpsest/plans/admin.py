"""Forgetting, revoking, admin jobs, inspection, record rules and curation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import admin as op
from palimpsest.operators import validation as va
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, DAY_MS, EPISODES, NOW_MS, OBSERVATIONS, SKEW_MS, table, with_

_VIEWS = "views AS (SELECT 'cur-' || user_id AS id, any_value(state_key) AS state_key, min(content_id) AS content_id, min(id) AS observation_id, list_sort(list(DISTINCT evidence_id)) AS evidence FROM observations GROUP BY user_id)"
_ASKED = {
    "request_id": "c_custkey",
    "selector": "CASE c_custkey % 5 WHEN 0 THEN 'episode' WHEN 1 THEN 'observation' WHEN 2 THEN 'content' WHEN 3 THEN 'state' ELSE 'current' END",
    "value": "CASE WHEN c_custkey % 37 = 4 THEN 'my-password' WHEN c_custkey % 5 = 0 THEN 'ep-' || (c_custkey % 90) || '-1' WHEN c_custkey % 5 = 1 THEN 'obs-' || c_custkey WHEN c_custkey % 5 = 2 THEN 'content:error' WHEN c_custkey % 5 = 3 THEN 'state:' || (c_custkey % 40) ELSE 'cur-' || (c_custkey % 170) END",
    "scope": "CASE WHEN c_custkey % 4 = 0 THEN 'occurrence' WHEN c_custkey % 4 = 1 THEN 'content' ELSE 'state' END",
}
_JSON = "CASE WHEN len({0}) = 0 THEN '[]' ELSE '[\"' || array_to_string({0}, '\",\"') || '\"]' END"
_PLANS = f"""
joined AS (SELECT a.*, v.state_key, v.content_id, v.observation_id, v.evidence FROM asked a LEFT JOIN views v ON a.selector = 'current' AND a.value = v.id),
targeted AS (SELECT *, CASE scope WHEN 'occurrence' THEN coalesce(observation_id, CASE WHEN selector IN ('episode', 'observation') THEN value END) WHEN 'content' THEN coalesce(content_id, CASE WHEN selector = 'content' THEN value END)
    ELSE coalesce(state_key, CASE WHEN selector = 'state' THEN value END) END AS target, coalesce(evidence, CASE WHEN selector = 'episode' THEN [value] ELSE CAST([] AS VARCHAR[]) END) AS provenance0 FROM joined),
faulted AS (SELECT *, CASE WHEN regexp_matches(value, '(?i)(api[-_]?key|access[-_]?token|auth(?:orization|entication)?|bearer|credential|password|secret|token)') THEN 'selector is not plain'
    WHEN NOT (selector = 'current' OR (selector IN ('episode', 'observation') AND scope = 'occurrence') OR (selector = scope)) THEN 'scope does not fit' WHEN target IS NULL THEN 'cannot be resolved' END AS error FROM targeted),
plans AS (SELECT request_id, selector, value, scope, CASE WHEN error IS NULL THEN [target] END AS targets, CASE WHEN error IS NULL THEN provenance0 END AS provenance, scope <> 'occurrence' AS recurrence_blocked,
    CASE WHEN error IS NULL THEN sha256('{{"operation":"forget","provenance":' || {_JSON.format("provenance0")} || ',"scope":"' || scope || '","selection":{{"' || selector || '":"' || value || '"}},"targets":' || {_JSON.format("[target]")} || '}}') END AS plan_id, error FROM faulted)"""
_FORGET = (OBSERVATIONS, _VIEWS, rec.cte("asked", "customer", _ASKED), _PLANS)


def _plans(spark, sf_dir):
    obs = rec.observations(spark, sf_dir)
    views = obs.groupBy(F.concat(F.lit("cur-"), "user_id").alias("id")).agg(F.first("state_key").alias("state_key"), F.min("content_id").alias("content_id"), F.min("id").alias("observation_id"), F.collect_set("evidence_id").alias("evidence_ids"))
    return op.plan_forget(rec.derived(spark, sf_dir, "customer", _ASKED), views)


@query("ad1_forget_plans", with_(*_FORGET) + "SELECT request_id, array_to_string(targets, ',') AS targets, len(provenance) AS n_provenance, recurrence_blocked, plan_id, error FROM plans")
def ad1_forget_plans(spark, sf_dir):
    """AD1: plans of forgetting: one selector each, the scopes that fit it, its closure and an id by content."""
    return _plans(spark, sf_dir).select("request_id", F.array_join("targets", ",").alias("targets"), F.when(F.col("provenance").isNotNull(), F.size("provenance")).cast("long").alias("n_provenance"), "recurrence_blocked", "plan_id", "error")


@query("ad2_forget_apply", with_(*_FORGET, "w AS (SELECT scope, unnest(targets) AS target_id, plan_id FROM plans WHERE request_id % 3 <> 1 AND error IS NULL UNION ALL SELECT 'occurrence', unnest(provenance), plan_id FROM plans WHERE request_id % 3 <> 1 AND error IS NULL)") + "SELECT scope, target_id, min(plan_id) AS plan_id FROM w WHERE NOT (scope = 'occurrence' AND target_id LIKE 'ep-1%') GROUP BY scope, target_id")
def ad2_forget_apply(spark, sf_dir):
    """AD2: tombstones that approved plans add to those that are there."""
    plans = _plans(spark, sf_dir)
    approvals = plans.filter("request_id % 3 <> 1").select("plan_id")
    # plans of equal content have one id; the oracle approves by request
    stored = rec.episodes(spark, sf_dir).select(F.lit("occurrence").alias("scope"), F.col("id").alias("target_id")).unionByName(rec.observations(spark, sf_dir).select(F.lit("occurrence").alias("scope"), F.col("evidence_id").alias("target_id"))).unionByName(plans.select(F.lit("occurrence").alias("scope"), F.col("value").alias("target_id")))
    return op.apply_forget(plans, approvals, stored.filter("target_id LIKE 'ep-1%'").distinct())


_CONTROL = {"owner_host": "'host-' || n_nationkey", "version": "CAST(n_nationkey % 4 AS BIGINT)", "active_generation": "CASE WHEN n_nationkey % 3 = 0 THEN 'g' || n_nationkey END", "policy_epoch": "CAST(n_nationkey % 2 AS BIGINT)", "privacy_epoch": "CAST(n_nationkey % 5 AS BIGINT)", "state": "CASE WHEN n_nationkey % 6 = 1 THEN 'draining' ELSE 'active' END"}


def control(spark, sf_dir):
    """A control row for each nation, some of them draining."""
    return rec.derived(spark, sf_dir, "nation", _CONTROL).withColumn("revoked", F.when(F.col("version") == 2, F.array(F.lit("d1"))).otherwise(F.array().cast("array<string>")))


CONTROL = rec.cte("c0", "nation", _CONTROL) + ",\ncontrol AS (SELECT *, CASE WHEN version = 2 THEN ['d1'] ELSE CAST([] AS VARCHAR[]) END AS revoked FROM c0)"


@query("ad3_revocations", with_(CONTROL, """
r AS (SELECT owner_host, privacy_epoch, list_sort(CASE WHEN version = 0 THEN ['d2', 'd1'] ELSE ['d3'] END) AS d FROM control),
p AS (SELECT owner_host, d, sha256('{"destinations":["' || array_to_string(d, '","') || '"],"from":' || privacy_epoch || ',"operation":"privacy_revoke","owner":"' || owner_host || '","reason":"audit","to":' || (privacy_epoch + 1) || '}') AS plan_id FROM r)""") + """
SELECT c.owner_host, plan_id, CASE WHEN hit THEN c.version + 1 ELSE c.version END AS version, CASE WHEN hit THEN c.privacy_epoch + 1 ELSE c.privacy_epoch END AS privacy_epoch, CASE WHEN NOT hit THEN c.active_generation END AS active_generation,
  array_to_string(CASE WHEN hit THEN list_sort(list_distinct(list_concat(c.revoked, d))) ELSE c.revoked END, ',') AS revoked
FROM (SELECT *, policy_epoch = 1 AS hit FROM control) c JOIN p USING (owner_host)""")
def ad3_revocations(spark, sf_dir):
    """AD3, U4: plans of revoking, and the control rows after those that were approved; a generation goes with its epoch."""
    rows = control(spark, sf_dir)
    asked = rows.select("owner_host", F.when(F.col("version") == 0, F.array(F.lit("d2"), F.lit("d1"))).otherwise(F.array(F.lit("d3"))).alias("destinations"), F.lit("audit").alias("reason"))
    plans = op.plan_revoke(asked, rows)
    approved = plans.join(rows.filter("policy_epoch = 1").select("owner_host"), "owner_host", "left_semi").select("plan_id")
    after = op.apply_revoke(rows, plans, approved)
    return after.join(plans.select("owner_host", "plan_id"), "owner_host").select("owner_host", "plan_id", "version", "privacy_epoch", "active_generation", F.array_join("revoked", ",").alias("revoked"))


@query("ad6_admin_jobs", with_(EPISODES, OBSERVATIONS, "n AS (SELECT id, processing_policy_id AS policy_id, (row_number() OVER (PARTITION BY processing_policy_id ORDER BY id) - 1) // 16 AS chunk FROM episodes WHERE id NOT IN (SELECT evidence_id FROM observations WHERE value > 50))") + "SELECT policy_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, sha256('[\"curate\",\"' || policy_id || '\",[\"' || string_agg(id, '\",\"' ORDER BY id) || '\"]]') AS job_id FROM n GROUP BY policy_id, chunk")
def ad6_admin_jobs(spark, sf_dir):
    """AD6, C1, C11: jobs of an admin verb over what is uncovered, of bounded size, with ids by content."""
    covered = rec.observations(spark, sf_dir).filter("value > 50").select(F.col("evidence_id").alias("id")).distinct()
    return op.enqueue(rec.episodes(spark, sf_dir), covered, "curate", 16)


_INSPECTED = {"id": "CASE WHEN page_id % 50 = 7 THEN 'token-' || page_id ELSE 'page-' || page_id END", "record_type": "'episode'", "state": "CASE WHEN page_id % 9 = 2 THEN 'my secret' WHEN page_id % 9 = 3 THEN 'a' || chr(7) ELSE 'ok' END", "version": "page_id % 7", "url": "url"}


@query("ad5_inspection", with_(rec.cte("r", "pages", _INSPECTED), "s AS (SELECT id, record_type, CASE WHEN NOT regexp_matches(state, '(?i)secret') AND NOT regexp_matches(state, '[\\x00-\\x1f]') THEN state END AS state, version FROM r WHERE NOT regexp_matches(id, '(?i)token') ORDER BY id LIMIT 64)") + "SELECT s.*, (SELECT count(*) > 64 FROM r WHERE NOT regexp_matches(id, '(?i)token')) AS truncated, (SELECT sha256(string_agg(id || '|' || record_type || '|' || coalesce(state, '-') || '|' || version, chr(10) ORDER BY id)) FROM s) AS content_hash FROM s")
def ad5_inspection(spark, sf_dir):
    """P8, T4, A19, AD5: a page of metadata without what looks secret, whether more follow, and its hash."""
    return op.inspect(rec.derived(spark, sf_dir, "pages", _INSPECTED), 64)


# --- rules ---

_ENVELOPE = {"owner_host": "CASE WHEN k % 43 = 5 THEN 'gamma' ELSE 'alpha' END", "schema_revision": "CASE WHEN k % 47 = 6 THEN 2 ELSE 1 END", "created_at": f"CASE WHEN k % 53 = 7 THEN -1 ELSE {BASE_MS} + k END", "privacy_epoch": "CASE WHEN k % 59 = 8 THEN 4294967296 ELSE k % 3 END", "processing_policy_id": "CASE WHEN k % 61 = 9 THEN 'secret-pol' ELSE 'pol1' END", "expires_at": "CASE WHEN k % 67 = 10 THEN -5 WHEN k % 2 = 0 THEN 1704067200000 END", "content_hash": "CASE WHEN k % 71 = 11 THEN '' ELSE 'h' || k END"}
_RULED = {
    "episode": ("(SELECT conv_id * 100 + turn AS k, role, text, turn FROM conversations)", {"id": "CASE WHEN k % 41 = 4 THEN 'bearer-' || k ELSE 'ep-' || k END", **_ENVELOPE, "project_id": "CASE WHEN k % 11 <> 0 THEN 'p1' END", "session_id": "'s1'", "agent_role": "CASE WHEN k % 73 = 12 THEN 'other' ELSE 'root' END", "depth": "k % 3 - CASE WHEN k % 31 = 0 THEN 3 ELSE 0 END", "event_kind": "role", "event_at": f"{BASE_MS} + k", "status": "'active'", "secret_scan": "'passed'", "text": "CASE WHEN turn = 9 THEN '' ELSE text END", "tool_name": "CASE WHEN turn = 8 THEN '' END", "session_sequence": "CASE WHEN turn = 7 THEN 4294967296 ELSE turn * 65536 END"}),
    "curated_memory": ("(SELECT event_id AS k, value, event_type FROM events)", {"id": "'obs-' || k", **_ENVELOPE, "content_id": "'content:' || event_type", "observation_id": "CASE WHEN k % 79 = 13 THEN 'other' ELSE 'obs-' || k END", "effective_at": f"CASE WHEN k % 83 = 14 THEN 4133980800000 ELSE {BASE_MS} END", "confidence": "CASE WHEN k % 3 = 0 THEN value / 400 END", "text": "'t'"}),
    "lease": ("(SELECT o_orderkey AS k FROM orders)", {"id": "'l-' || k", **_ENVELOPE, "job_id": "'job-' || k", "owner_id": "'node1'", "version": "k % 5", "fencing_token": "k % 4", "state": "CASE k % 5 WHEN 0 THEN 'leased' WHEN 1 THEN 'accepted' WHEN 2 THEN 'released' WHEN 3 THEN 'completed' ELSE 'lost' END", "accepted_proposal_id": "CASE WHEN k % 3 = 1 THEN 'p' END", "accepted_manifest_hash": "CASE WHEN k % 3 = 1 OR k % 29 = 2 THEN 'm' END"}),
    "tombstone": ("(SELECT c_custkey AS k FROM customer)", {"id": "'t-' || k", **_ENVELOPE, "scope": "CASE k % 4 WHEN 0 THEN 'occurrence' WHEN 1 THEN 'content' WHEN 2 THEN 'state' ELSE 'all' END", "target_id": "CASE WHEN k % 6 < 3 THEN CASE k % 4 WHEN 0 THEN 'occurrence:' WHEN 1 THEN 'content:' ELSE 'state:' END || repeat('0a', 32) WHEN k % 6 = 3 THEN '123e4567-e89b-12d3-a456-426614174000' ELSE 'state:short' END"}),
}
_SECRET = "'(?i)(api[-_]?key|access[-_]?token|auth(?:orization|entication)?|bearer|credential|password|secret|token)'"
_UINT = "coalesce({0} BETWEEN 0 AND 4294967295, false)"
_TIME = "coalesce({0} BETWEEN 0 AND 4133980799999, false)"
_TARGET = "CASE scope WHEN 'occurrence' THEN regexp_full_match(target_id, 'occurrence:[0-9a-f]{64}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') WHEN 'content' THEN regexp_full_match(target_id, 'content:[0-9a-f]{64}') ELSE regexp_full_match(target_id, 'state:[0-9a-f]{64}') END"
_COMMON = f"WHEN regexp_matches(id, {_SECRET}) THEN 'id' WHEN owner_host NOT IN ('alpha', 'beta') THEN 'owner' WHEN schema_revision <> 1 THEN 'revision' WHEN NOT {_TIME.format('created_at')} THEN 'created' WHEN NOT {_UINT.format('privacy_epoch')} THEN 'epoch' WHEN regexp_matches(processing_policy_id, {_SECRET}) THEN 'policy' WHEN NOT {_TIME.format('expires_at')} AND {{0}} THEN 'expiry' WHEN content_hash = '' THEN 'hash'"
_RULES = {
    "episode": _COMMON.format("expires_at IS NOT NULL") + f" WHEN project_id IS NULL THEN 'project' WHEN agent_role NOT IN ('root', 'child') THEN 'role' WHEN NOT {_UINT.format('depth')} THEN 'depth' WHEN event_kind NOT IN ('user', 'assistant', 'tool_call', 'tool_result', 'tool_error') THEN 'kind' WHEN text IS NOT NULL AND (text = '' OR length(text) > 16000) THEN 'text' WHEN tool_name = '' THEN 'tool' WHEN session_sequence IS NOT NULL AND NOT {_UINT.format('session_sequence')} THEN 'sequence'",
    "curated_memory": _COMMON.format("expires_at IS NOT NULL") + f" WHEN observation_id <> id THEN 'observation' WHEN NOT {_TIME.format('effective_at')} THEN 'effective' WHEN len(sources) < 1 OR list_sort(list_distinct(sources)) <> sources THEN 'sources' WHEN confidence IS NOT NULL AND NOT confidence BETWEEN 0 AND 1 THEN 'confidence'",
    "lease": _COMMON.format("true") + " WHEN version < 1 THEN 'version' WHEN state NOT IN ('leased', 'accepted', 'released', 'completed') THEN 'state' WHEN (accepted_proposal_id IS NULL) <> (accepted_manifest_hash IS NULL) THEN 'pair' WHEN state = 'leased' AND accepted_proposal_id IS NOT NULL THEN 'leased' WHEN state IN ('accepted', 'completed') AND accepted_proposal_id IS NULL THEN 'accepted'",
    "tombstone": _COMMON.format("expires_at IS NOT NULL") + f" WHEN scope NOT IN ('occurrence', 'content', 'state') THEN 'scope' WHEN NOT coalesce({_TARGET}, false) THEN 'target'",
}
_SOURCES = "CASE WHEN k % 89 = 15 THEN CAST([] AS VARCHAR[]) WHEN k % 97 = 16 THEN ['b', 'a'] WHEN k % 7 = 0 THEN ['a', 'b'] ELSE ['a'] END AS sources"
_JUDGED = ", ".join(f"{t} AS (SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())}{', ' + _SOURCES if t == 'curated_memory' else ''} FROM {source})" for t, (source, columns) in _RULED.items())


@query("f18_validity", f"WITH {_JUDGED} " + " UNION ALL ".join(f"SELECT '{t}' AS record_type, reason, count(*) AS n FROM (SELECT CASE {rules} ELSE 'valid' END AS reason FROM {t}) GROUP BY reason" for t, rules in _RULES.items()))
def f18_validity(spark, sf_dir):
    """records of the other four types by the first rule of their closed schema that they break."""
    k = {"episode": ("conversations", F.expr("conv_id * 100 + turn")), "curated_memory": ("events", F.col("event_id")), "lease": ("orders", F.col("o_orderkey")), "tombstone": ("customer", F.col("c_custkey"))}
    out = None
    for t, (source, columns) in _RULED.items():
        name, key = k[t]
        rows = table(spark, sf_dir, name).withColumn("k", key)
        lists = []
        if t == "curated_memory":
            n = F.col("k")
            lists = [F.when(n % 89 == 15, F.array().cast("array<string>")).when(n % 97 == 16, F.array(F.lit("b"), F.lit("a"))).when(n % 7 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("source_episode_ids")]
        typed = rows.select(*[F.expr(sql).alias(c) for c, sql in columns.items()], *lists)
        counted = va.validate(typed, t).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("record_type"), "reason", "n")
        out = counted if out is None else out.unionByName(counted)
    return out


#: The hash of the members a and b.
_AB = "0473ef2dc0d324ab659d3580c1134e9d812035905c4781fdd6d529b0c6860e13"
_LIST = "split(CASE WHEN k % 23 = 5 THEN 'b,a' WHEN k % 19 = 6 THEN 'a,a' WHEN k % 17 = 7 THEN 'a,token' ELSE 'a,b' END, ',')"
_EPOCHS = {"coordination_policy_hash": "CASE WHEN k % 37 = 3 THEN '' ELSE 'ch' END", "coordination_policy_epoch": "CASE WHEN k % 29 = 2 THEN -1 ELSE k % 3 END"}
_MADE = {"id": "'r-' || k", **_ENVELOPE, **_EPOCHS}
_REVISION = {"extractor_revision": "CASE WHEN k % 13 = 4 THEN 'bearer' ELSE 'x1' END"}
_COORDINATED = {
    "job": ("orders", "o_orderkey", _MADE | {"policy_id": "CASE WHEN k % 11 = 1 THEN 'pol2' ELSE 'pol1' END", "policy_hash": "CASE WHEN k % 31 = 4 THEN 'other' ELSE 'ch' END", "policy_epoch": "CASE WHEN k % 7 = 6 THEN 9 ELSE k % 3 END", "membership": _LIST, **_REVISION}),
    "proposal": ("part", "p_partkey", _MADE | {"job_id": "'j' || k", "owner_id": "CASE WHEN k % 11 = 1 THEN '' ELSE 'node1' END", "proposal_hash": "repeat('0', CASE WHEN k % 9 = 2 THEN 63 ELSE 64 END)", "manifest_hash": f"CASE WHEN k % 8 = 3 THEN 'm' ELSE '{_AB}' END", "fencing_token": "k % 5 - CASE WHEN k % 35 = 0 THEN 1 ELSE 0 END", "membership": _LIST}),
    "coverage": ("events", "event_id", _MADE | {"episode_id": "CASE WHEN k % 12 = 5 THEN NULL ELSE 'e' || k END", **_REVISION}),
    "evidence_link": ("lineitem", "l_orderkey * 8 + l_linenumber", _MADE | {"source_id": "CASE WHEN k % 10 = 1 THEN 'password' ELSE 's' END", "target_id": "CASE WHEN k % 14 = 3 THEN '' ELSE 't' END", "job_id": "CASE WHEN k % 15 = 4 THEN NULL ELSE 'j' END", **_REVISION}),
    "conflict_manifest": ("customer", "c_custkey", _MADE | {"state_key": "CASE WHEN k % 10 = 1 THEN repeat('s', 513) ELSE 'token' END", "members": "split(CASE WHEN k % 23 = 5 THEN 'b,a' WHEN k % 9 = 6 THEN 'a' ELSE 'a,b' END, ',')"}),
    "collection_control": ("nation", "n_nationkey", _MADE | {"version": "k % 5", "active_generation": "CASE WHEN k % 6 = 1 THEN '' WHEN k % 2 = 0 THEN 'g' END", "active_base_generation": "'g0'", "state": "CASE WHEN k % 7 = 2 THEN 'gone' ELSE 'active' END", "scan_cursor": "CASE WHEN k % 8 = 4 THEN '' END", "last_forget_barrier": "CASE WHEN k % 9 = 8 THEN -1 END", "revoked_destination_ids": "split(CASE WHEN k % 4 = 1 THEN 'd,d' WHEN k % 4 = 2 THEN 'a b' ELSE 'd1,d2' END, ',')"}),
    "processing_policy": ("supplier", "s_suppkey", {**_ENVELOPE, "id": "'pol1'", "policy_id": "'pol1'", "policy_owner_host": "CASE WHEN k % 6 = 1 THEN 'beta' ELSE 'alpha' END", "policy_expires_at": "CASE WHEN k % 8 <> 2 AND k % 2 = 0 THEN 1704067200000 END", "canonical_hash": "CASE WHEN k % 5 = 3 THEN 'z' ELSE 'pol1' END"}),
    "curated_current": ("events", "event_id", _MADE | {"version": "k % 7", "state_key": "'k'", "project_id": "CASE WHEN k % 12 = 1 THEN '' END", "scope": "'project'", "resolution": "CASE k % 5 WHEN 0 THEN 'conflict' WHEN 1 THEN 'maybe' ELSE 'resolved' END", "content_id": "CASE WHEN k % 5 <> 0 THEN 'c' END", "observation_id": "CASE WHEN k % 5 <> 0 THEN 'o' END", "text": "CASE WHEN k % 5 <> 0 AND k % 9 <> 1 THEN 't' END", "conflict_manifest_hash": "CASE WHEN k % 5 = 0 AND k % 4 <> 3 OR k % 11 = 5 THEN 'm' END", "source_episode_ids": f"CASE WHEN k % 2 = 0 THEN {_LIST} END"}),
    "raptor_summary": ("documents", "doc_id", _MADE | {"generation_id": "'g'", "cluster_id": "'c' || k", "membership_hash": f"CASE WHEN k % 8 = 3 THEN 'm' ELSE '{_AB}' END", "level": "k % 4", "member_ids": "CASE WHEN k % 3 = 0 THEN split('a,b', ',') END", "manifest_hash": "CASE WHEN k % 7 = 1 THEN NULL ELSE 'm' END", "summary": "text", "model_id": "'m'", "embedding_dimension": "CASE WHEN k % 10 = 4 THEN 3 ELSE 1024 END", "prompt_revision": "'p'", "algorithm": "'a'", "seed": "CASE WHEN k % 12 = 5 THEN 4294967296 ELSE k END", "job_id": "'j'", "fencing_token": "1", "temporal_from": f"{BASE_MS} + k % 6", "temporal_to": f"{BASE_MS} + 3", "covered_projects": "split(CASE WHEN k % 16 = 9 THEN 'p,' ELSE 'p' END, ',')", "algorithm_parameters": "lang"}),
}
_KEYED = "coordination_policy_hash = '' THEN 'coordination hash' WHEN coordination_policy_epoch < 0 THEN 'coordination epoch'"
_BROKEN_LIST = "{0} IS NOT NULL AND (list_sort(list_distinct({0})) <> {0} OR list_contains({0}, 'token'))"
_OWN = {
    "job": f"WHEN {_KEYED} WHEN policy_id <> processing_policy_id THEN 'job policy' WHEN policy_hash <> coordination_policy_hash THEN 'policy hash' WHEN policy_epoch <> coordination_policy_epoch THEN 'policy epoch' WHEN {_BROKEN_LIST.format('membership')} THEN 'membership' WHEN extractor_revision = 'bearer' THEN 'extractor'",
    "proposal": f"WHEN {_KEYED} WHEN owner_id = '' THEN 'holder' WHEN length(proposal_hash) <> 64 THEN 'proposal hash' WHEN fencing_token < 0 THEN 'fence' WHEN {_BROKEN_LIST.format('membership')} THEN 'membership' WHEN manifest_hash <> sha256('[\"' || array_to_string(membership, '\",\"') || '\"]') THEN 'manifest'",
    "coverage": f"WHEN {_KEYED} WHEN episode_id IS NULL THEN 'episode' WHEN extractor_revision = 'bearer' THEN 'extractor'",
    "evidence_link": f"WHEN {_KEYED} WHEN source_id = 'password' THEN 'source' WHEN target_id = '' THEN 'target' WHEN job_id IS NULL THEN 'job' WHEN extractor_revision = 'bearer' THEN 'extractor'",
    "conflict_manifest": f"WHEN {_KEYED} WHEN length(state_key) > 512 THEN 'state key' WHEN len(members) < 2 OR {_BROKEN_LIST.format('members')} THEN 'members'",
    "collection_control": f"WHEN {_KEYED} WHEN version < 1 THEN 'version' WHEN active_generation = '' THEN 'generation' WHEN state NOT IN ('active', 'draining', 'retired') THEN 'state' WHEN scan_cursor = '' THEN 'cursor' WHEN last_forget_barrier < 0 THEN 'barrier' WHEN len(list_distinct(revoked_destination_ids)) < len(revoked_destination_ids) OR list_contains(revoked_destination_ids, 'a b') THEN 'destinations'",
    "processing_policy": "WHEN policy_owner_host <> owner_host THEN 'policy owner' WHEN policy_expires_at IS DISTINCT FROM expires_at OR policy_id <> processing_policy_id THEN 'policy envelope' WHEN canonical_hash <> id THEN 'policy hash'",
    "curated_current": f"WHEN {_KEYED} WHEN version < 1 THEN 'version' WHEN project_id = '' THEN 'project' WHEN resolution = 'maybe' THEN 'resolution' WHEN resolution = 'resolved' AND (text IS NULL OR conflict_manifest_hash IS NOT NULL) THEN 'resolved' WHEN resolution = 'conflict' AND conflict_manifest_hash IS NULL THEN 'conflict' WHEN {_BROKEN_LIST.format('source_episode_ids')} THEN 'sources'",
    "raptor_summary": f"WHEN {_KEYED} WHEN member_ids IS NULL AND manifest_hash IS NULL THEN 'closure' WHEN member_ids IS NOT NULL AND membership_hash = 'm' THEN 'membership hash' WHEN text IS NULL OR text = '' OR length(text) > 16000 THEN 'summary' WHEN embedding_dimension <> 1024 THEN 'dimension' WHEN seed > 4294967295 THEN 'seed' WHEN temporal_from > temporal_to THEN 'range' WHEN list_contains(covered_projects, '') THEN 'projects'",
}


def _coordinated_sql() -> str:
    parts = []
    for t, (source, key, columns) in _COORDINATED.items():
        rows = f"(SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())}{', text' if t == 'raptor_summary' else ''} FROM (SELECT *, {key} AS k FROM {source}))"
        parts.append(f"SELECT '{t}' AS record_type, reason, count(*) AS n FROM (SELECT CASE {_COMMON.format('expires_at IS NOT NULL')} {_OWN[t]} ELSE 'valid' END AS reason FROM {rows}) GROUP BY reason")
    return " UNION ALL ".join(parts)


@query("f18_coordination_validity", _coordinated_sql())
def f18_coordination_validity(spark, sf_dir):
    """records of the nine types of coordination, current values and summaries by the first rule that they break."""
    out = None
    for t, (source, key, columns) in _COORDINATED.items():
        rows = table(spark, sf_dir, source).withColumn("k", F.expr(key))
        counted = va.validate(rows.select(*[F.expr(sql).alias(c) for c, sql in columns.items()]), t).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("record_type"), "reason", "n")
        out = counted if out is None else out.unionByName(counted)
    return out


_ITEM = {
    "result_id": "user_id % 40", "item": "event_id", "category": "CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'preference' WHEN 'view' THEN 'correction' WHEN 'purchase' THEN 'fact' ELSE 'gossip' END",
    "scope": "CASE WHEN event_id % 53 = 1 THEN 'galaxy' ELSE 'project' END", "subject": "CASE WHEN event_id % 59 = 2 THEN '' WHEN event_id % 61 = 3 THEN 'the API key' ELSE 'user' || user_id END", "predicate": "CASE WHEN event_id % 67 = 4 THEN repeat('x', 513) ELSE 'does' END",
    "value": "CASE WHEN event_id % 71 = 5 THEN repeat('y', 4097) WHEN event_id % 3 = 0 THEN 'v' || (event_id % 5) END", "text": "CASE WHEN event_id % 73 = 6 THEN 'the password' WHEN event_id % 3 = 1 THEN 'said ' || event_id END", "confidence": "CASE WHEN event_id % 79 = 7 THEN 1.5 WHEN event_id % 2 = 0 THEN 0.5 END",
}
_EVIDENCE = "CASE WHEN event_id % 83 = 8 THEN CAST([] AS VARCHAR[]) WHEN event_id % 89 = 9 THEN ['bad id'] WHEN event_id % 97 = 10 THEN ['ep-1-0', 'ep-1-0'] ELSE ['ep-' || (event_id % 60) || '-0', 'ep-' || (event_id % 60) || '-1'] END"


@query("ad7_curation_validation", with_(rec.cte("i0", "events", _ITEM), EPISODES, f"i AS (SELECT *, (SELECT {_EVIDENCE} FROM events v WHERE v.event_id = i0.item) AS evidence FROM i0)", """
l AS (SELECT i.result_id, i.item, bool_or(e.id IS NULL) AS is_foreign, coalesce(bool_or(e.event_kind = 'user'), false) AS direct FROM (SELECT result_id, item, unnest(evidence) AS x FROM i) i LEFT JOIN episodes e ON e.id = i.x AND e.conv_id % 7 <> 3 GROUP BY 1, 2),
s AS (SELECT i.*, l.is_foreign, l.direct, count(*) OVER (PARTITION BY result_id, category, scope, subject, predicate, value, text, evidence, confidence) AS same, count(*) OVER (PARTITION BY result_id) AS n FROM i LEFT JOIN l USING (result_id, item))""") + """
SELECT result_id, item, CASE WHEN category NOT IN ('preference', 'correction', 'convention', 'fact', 'failure', 'learning') THEN 'category' WHEN scope NOT IN ('project', 'session', 'host', 'global') THEN 'scope'
  WHEN subject = '' OR length(subject) > 512 OR regexp_matches(subject, '(?i)(api[-_]?key|password)') THEN 'subject' WHEN length(predicate) > 512 THEN 'predicate' WHEN length(value) > 4096 THEN 'value'
  WHEN text IS NOT NULL AND regexp_matches(text, '(?i)password') THEN 'text' WHEN value IS NULL AND text IS NULL THEN 'empty' WHEN confidence > 1 THEN 'confidence' WHEN len(evidence) < 1 THEN 'evidence' WHEN evidence[1] = 'bad id' THEN 'evidence id'
  WHEN len(list_distinct(evidence)) < len(evidence) THEN 'repeated evidence' WHEN coalesce(is_foreign, true) THEN 'foreign evidence' WHEN category IN ('preference', 'correction') AND NOT direct THEN 'no direct evidence'
  WHEN same > 1 THEN 'repeated item' WHEN n > 32 THEN 'too many items' ELSE 'valid' END AS reason FROM s""")
def ad7_curation_validation(spark, sf_dir):
    """AD7: each item of a curation result by the first rule that it breaks."""
    e = F.col("item")
    pair = F.array(F.concat(F.lit("ep-"), e % 60, F.lit("-0")), F.concat(F.lit("ep-"), e % 60, F.lit("-1")))
    evidence = F.when(e % 83 == 8, F.array().cast("array<string>")).when(e % 89 == 9, F.array(F.lit("bad id"))).when(e % 97 == 10, F.array(F.lit("ep-1-0"), F.lit("ep-1-0"))).otherwise(pair)
    items = rec.derived(spark, sf_dir, "events", _ITEM).withColumn("evidence", evidence).withColumn("confidence", F.col("confidence").cast("double"))
    members = rec.episodes(spark, sf_dir).filter("conv_id % 7 <> 3").select(F.col("id").alias("episode_id"), (F.col("event_kind") == "user").alias("direct"))
    results = items.select("result_id").distinct()
    # a result's members are all of these episodes
    return va.validate_items(items, members.join(F.broadcast(results), F.lit(True)), 32)


@query("ad4_status", with_(rec.MEMORY, rec.JOBS) + f"SELECT record_type, status, count(*) AS n, count(*) FILTER (expires_at <= {NOW_MS + SKEW_MS}) AS expired FROM memory GROUP BY ALL UNION ALL SELECT 'job', state, count(*), count(*) FILTER (lease_expires_at + {SKEW_MS} <= {BASE_MS - 2000 * DAY_MS}) FROM jobs GROUP BY state")
def ad4_status(spark, sf_dir):
    """A10, AD4: the report: records by type and status, jobs by state, and what has lapsed of each."""
    kept = rec.memory(spark, sf_dir).groupBy("record_type", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expires_at") <= NOW_MS + SKEW_MS).alias("expired"))
    jobs = rec.jobs(spark, sf_dir).groupBy(F.lit("job").alias("record_type"), F.col("state").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lease_expires_at") + SKEW_MS <= BASE_MS - 2000 * DAY_MS).alias("expired"))
    return kept.unionByName(jobs)


@query("f10_read_policy", with_(rec.MEMORY) + f"SELECT record_type, count(*) AS n FROM memory WHERE owner_host = 'alpha' AND status = 'active' AND secret_scan = 'passed' AND record_type IN ('episode', 'curated_memory', 'lease', 'tombstone') AND privacy_epoch = 1 AND record_type <> 'tombstone' AND (record_type = 'lease' OR expires_at IS NULL OR expires_at > {NOW_MS + SKEW_MS}) GROUP BY record_type")
def f10_read_policy(spark, sf_dir):
    """records that a query may read: coordination rows do not expire, and tombstones are read internally only."""
    from palimpsest.operators.retrieval import read_policy

    keep = read_policy("alpha", ["episode", "curated_memory", "lease", "tombstone"], NOW_MS, SKEW_MS, privacy_epoch=1)
    return rec.memory(spark, sf_dir).filter(keep).groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))
