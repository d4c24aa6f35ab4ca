"""Windows and temporal state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import temporal as op
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, DAY_MS, EPISODES, OBSERVATIONS, SKEW_MS, with_

_INTERVALS = """
kept AS (
  SELECT *, lag(content_id) OVER (PARTITION BY policy_epoch, state_key, scope, project_id ORDER BY effective_at, id) AS b FROM observations
), intervals AS (
  SELECT policy_epoch, state_key, scope, project_id, id, content_id, effective_at AS valid_from,
    lead(effective_at) OVER (PARTITION BY policy_epoch, state_key, scope, project_id ORDER BY effective_at, id) AS valid_to
  FROM kept WHERE b IS NULL OR b <> content_id
)"""


@query("w2_history_intervals", with_(OBSERVATIONS, _INTERVALS) + "SELECT * FROM intervals")
def w2_history_intervals(spark, sf_dir):
    """Intervals of each state; A-B-A stays visible."""
    return op.history_intervals(rec.observations(spark, sf_dir))


@query("w3_fold_segments", with_(OBSERVATIONS, """
m AS (SELECT *, CASE WHEN lag(content_id) OVER w = content_id THEN 0 ELSE 1 END AS new FROM observations WINDOW w AS (PARTITION BY state_key ORDER BY effective_at, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY state_key ORDER BY effective_at, id ROWS UNBOUNDED PRECEDING) AS segment FROM m),
g AS (SELECT state_key, CAST(segment AS BIGINT) AS segment, min(content_id) AS content_id, min(effective_at) AS valid_from, count(*) AS n_observations, arg_max(evidence_id, (effective_at, id)) AS primary_evidence FROM s GROUP BY 1, 2)""") + "SELECT *, lead(valid_from) OVER (PARTITION BY state_key ORDER BY segment) AS valid_to FROM g")
def w3_fold_segments(spark, sf_dir):
    """Runs of equal content folded, with their evidence."""
    return op.fold_segments(rec.observations(spark, sf_dir))


@query("w3_fold_mixed", with_(OBSERVATIONS, """
m AS (SELECT *, CASE WHEN lag(content_id) OVER w = content_id AND lag(state_key) OVER w = state_key THEN 0 ELSE 1 END AS new FROM observations WINDOW w AS (PARTITION BY project_id ORDER BY effective_at, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY project_id ORDER BY effective_at, id ROWS UNBOUNDED PRECEDING) AS segment FROM m),
g AS (SELECT project_id, CAST(segment AS BIGINT) AS segment, min(state_key) AS state_key, min(content_id) AS content_id, min(effective_at) AS valid_from, count(*) AS n_observations, arg_max(evidence_id, (effective_at, id)) AS primary_evidence FROM s GROUP BY 1, 2)""") + "SELECT *, lead(valid_from) OVER (PARTITION BY project_id ORDER BY segment) AS valid_to FROM g")
def w3_fold_mixed(spark, sf_dir):
    """The same fold over several states in one stream: the next segment of any state closes one."""
    return op.fold_segments(rec.observations(spark, sf_dir), ["project_id"])


@query("w6_prior_prompt", with_(EPISODES) + "SELECT id, last_value(CASE WHEN event_kind = 'user' AND length(regexp_replace(text, '\\s', '', 'g')) >= 20 AND left(ltrim(text), 1) <> '/' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_id FROM episodes")
def w6_prior_prompt(spark, sf_dir):
    """The last substantive prompt before each entry."""
    good = (F.col("event_kind") == "user") & (F.length(F.regexp_replace("text", r"[\t-\r ]", "")) >= 20) & ~F.ltrim("text").startswith("/")
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return rec.episodes(spark, sf_dir).select("id", F.last(F.when(good, F.col("id")), ignorenulls=True).over(before).alias("prior_id"))


@query("j13_as_of", with_(OBSERVATIONS, _INTERVALS) + f"SELECT state_key, id, content_id FROM intervals WHERE valid_from <= {BASE_MS + 10 * DAY_MS} AND (valid_to IS NULL OR valid_to > {BASE_MS + 10 * DAY_MS})")
def j13_as_of(spark, sf_dir):
    """What held at a time."""
    return op.as_of(op.history_intervals(rec.observations(spark, sf_dir)), BASE_MS + 10 * DAY_MS).select("state_key", "id", "content_id")


@query("a3_primary_evidence", with_(EPISODES, OBSERVATIONS, "l AS (SELECT o.state_key AS item_id, e.id, e.session_id, e.session_sequence, e.event_at FROM observations o JOIN episodes e ON o.evidence_id = e.id)") + "SELECT item_id, CASE WHEN count(DISTINCT session_id) = 1 AND count(session_sequence) = count(*) THEN 'session' ELSE 'tuple' END AS kind, max(session_sequence) AS max_sequence, arg_max(id, (event_at, id)) AS primary_evidence, max(event_at) AS event_at FROM l GROUP BY item_id")
def a3_primary_evidence(spark, sf_dir):
    """A3, A4: primary evidence and effective order of each item."""
    ep = rec.episodes(spark, sf_dir).select(F.col("id").alias("evidence_id"), "session_id", "session_sequence", "event_at")
    return op.effective_order(rec.observations(spark, sf_dir).select(F.col("state_key").alias("item_id"), "evidence_id").join(ep, "evidence_id").withColumnRenamed("evidence_id", "id"))


@query("a5_conflicts", with_(OBSERVATIONS, f"b AS (SELECT *, CAST(floor(effective_at / {6 * 3_600_000}) AS BIGINT) AS bucket FROM observations), r AS (SELECT state_key, bucket, content_id, arg_max(id, (effective_at, id)) AS id, max(effective_at) AS ms, arg_max(evidence_id, (effective_at, id)) AS e FROM b GROUP BY 1, 2, 3)") + "SELECT state_key, bucket, string_agg(id, ',' ORDER BY id) AS members, string_agg(DISTINCT e, ',' ORDER BY e) AS sources, max(ms) AS latest_at, min(ms) AS created_at, count(*) AS n_contents, 'conflict:' || sha256('[\"' || state_key || '\",\"' || string_agg(id, '|' ORDER BY id) || '\"]') AS manifest_id FROM r GROUP BY 1, 2 HAVING count(*) >= 2")
def a5_conflicts(spark, sf_dir):
    """A5: conflicts as content-addressed manifests: one representative of each content, their sources, latest and earliest times."""
    bucket = F.floor(F.col("effective_at") / (6 * 3_600_000)).cast("long")
    return op.conflicts(rec.observations(spark, sf_dir).withColumn("bucket", bucket), ["state_key", "bucket"])


_NEXT = "p AS (SELECT *, lag(effective_at) OVER w AS a_at, lag(content_id) OVER w AS a_content FROM observations WINDOW w AS (PARTITION BY state_key ORDER BY created_at, id))"
_COMPARE = f"CASE WHEN abs(a_at - effective_at) <= {SKEW_MS} THEN CASE WHEN a_content = content_id THEN 'equal' ELSE 'within_skew' END WHEN a_at < effective_at THEN 'before' ELSE 'after' END"


@query("st10_compare_orders", with_(OBSERVATIONS, "s AS (SELECT *, event_id % 3 AS session, event_id % 50 // 10 AS seq FROM observations), p AS (SELECT *, lag(effective_at) OVER w AS a_at, lag(content_id) OVER w AS a_content, lag(session) OVER w AS a_session, lag(seq) OVER w AS a_seq FROM s WINDOW w AS (PARTITION BY state_key ORDER BY created_at, id))") + f"SELECT id, CASE WHEN a_session = session AND session > 0 THEN CASE WHEN a_seq < seq THEN 'before' WHEN a_seq > seq THEN 'after' WHEN a_content = content_id THEN 'equal' ELSE 'within_skew' END ELSE {_COMPARE} END AS comparison FROM p WHERE a_at IS NOT NULL")
def st10_compare_orders(spark, sf_dir):
    """ST6, ST10: each arrival against the one before it, by sequence within a session and by time across."""
    w = Window.partitionBy("state_key").orderBy("created_at", "id")
    k = F.col("event_id")
    # session 0 stands for observations without one
    s = rec.observations(spark, sf_dir).withColumns({"session": F.when(k % 3 > 0, k % 3), "seq": F.floor(k % 50 / 10)})
    p = s.withColumns({f"a_{c}": F.lag(c).over(w) for c in ("effective_at", "content_id", "session", "seq")}).filter("a_effective_at IS NOT NULL")
    return p.select("id", op.compare_orders(F.col("a_effective_at"), F.col("effective_at"), F.col("a_content_id"), F.col("content_id"), SKEW_MS, (F.col("a_session"), F.col("a_seq")), (F.col("session"), F.col("seq"))).alias("comparison"))


@query("st9_decide_step", with_(OBSERVATIONS, _NEXT, f"d AS (SELECT id, a_at IS NOT NULL AS known, a_content = content_id AS same, {_COMPARE} AS c FROM p)") + "SELECT id, CASE WHEN NOT known THEN 'insert' WHEN same THEN CASE WHEN c = 'before' THEN 'update' ELSE 'converge' END WHEN c = 'within_skew' THEN 'conflict' WHEN c = 'equal' THEN 'converge' WHEN c = 'before' THEN 'update' ELSE 'late' END AS decision FROM d")
def st9_decide_step(spark, sf_dir):
    """ST9: one step of the current-value machine."""
    w = Window.partitionBy("state_key").orderBy("created_at", "id")
    p = rec.observations(spark, sf_dir).withColumns({"a_at": F.lag("effective_at").over(w), "a_content": F.lag("content_id").over(w)})
    c = op.compare_orders(F.col("a_at"), F.col("effective_at"), F.col("a_content"), F.col("content_id"), SKEW_MS)
    return p.select("id", op.decide(F.when(F.col("a_at").isNotNull(), "resolved"), F.col("a_content") == F.col("content_id"), c).alias("decision"))


_FOLD = f"""
n AS (SELECT state_key, effective_at, content_id, row_number() OVER (PARTITION BY state_key ORDER BY created_at, id) AS k FROM observations),
f(state_key, k, kind, content, ms, members, version) AS (
  SELECT state_key, k, 'resolved', content_id, effective_at, [content_id], CAST(1 AS BIGINT) FROM n WHERE k = 1
  UNION ALL
  SELECT state_key, next_k, CASE WHEN later THEN 'resolved' WHEN grows THEN 'conflict' ELSE kind END, CASE WHEN later THEN content_id WHEN grows THEN list_max(more) ELSE content END,
    CASE WHEN later THEN effective_at WHEN grows THEN greatest(ms, effective_at) ELSE ms END, CASE WHEN later THEN [content_id] WHEN grows THEN more ELSE members END, CASE WHEN later OR grows THEN version + 1 ELSE version END
  FROM (SELECT f.*, n.content_id, n.effective_at, n.k AS next_k, list_distinct(list_append(f.members, n.content_id)) AS more, f.ms < n.effective_at - {SKEW_MS} AS later,
    abs(f.ms - n.effective_at) <= {SKEW_MS} AND n.content_id <> f.content AND (f.kind = 'resolved' OR NOT list_contains(f.members, n.content_id)) AS grows FROM f JOIN n ON n.state_key = f.state_key AND n.k = f.k + 1)
)"""


@query("st9_fold_current", with_(OBSERVATIONS, _FOLD, recursive=True) + "SELECT state_key, kind, content, ms AS \"at\", array_to_string(list_sort(members), ',') AS members, version FROM f QUALIFY row_number() OVER (PARTITION BY state_key ORDER BY k DESC) = 1")
def st9_fold_current(spark, sf_dir):
    """ST9: the current value of each state after all arrivals (a sequential fold)."""
    return op.fold_current(rec.observations(spark, sf_dir), SKEW_MS).withColumn("members", F.array_join("members", ","))
