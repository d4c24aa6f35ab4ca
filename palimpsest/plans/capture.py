"""From log entries to episodes: scans, selection, fields, markers and triggers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import capture as op
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import ENTRIES, table, with_

_SECRET = "(api[-_]?key|access[-_]?token|auth(?:orization|entication)?|bearer|credential|password|secret|token)"
_SAFE = f"(length(entry_id) <= 512 AND regexp_full_match(entry_id, '[A-Za-z0-9._:/-]+') AND NOT regexp_matches(entry_id, '(?i){_SECRET}'))"
_FAILED = "'(?i)^(?:error|failed|failure|non[-_ ]?success|timeout|timed[-_ ]?out|cancel(?:ed|led)|killed|rejected|denied)$'"
_WRAPPED = r"'(?i)<memory[-_]context\b[^>]*>|</memory[-_]context>|\[memory[-_]context\]'"
#: The selection, stated a second time for the oracle.
SELECTED = rf"""
judged AS (
  SELECT *, lower(entry_type) AS kind, lower(role) AS r, coalesce(status, detail_status) AS st, coalesce(code, detail_code) AS cd,
    coalesce(is_error, false) OR coalesce(trim(error) <> '', false) OR coalesce(regexp_matches(status, {_FAILED}), false) OR coalesce(regexp_matches(detail_status, {_FAILED}), false)
      OR coalesce(code <> 0, false) OR coalesce(detail_code <> 0, false) AS failed,
    coalesce(regexp_matches(text, {_WRAPPED}), false) AS wrapped, coalesce(name = 'memory_search', false) AS own
  FROM entries
), open_ AS (
  SELECT *, r IN ('user', 'assistant') AS spoken, r IN ('user', 'assistant') AND name IS NOT NULL AND regexp_matches(lower(part_type), 'tool(call|_call)|function') AS call,
    left(CASE WHEN failed THEN concat_ws(chr(10), text, 'stderr: ' || stderr, 'status: ' || st, 'code: ' || cd, 'error: ' || error)
      ELSE concat_ws(chr(10), 'status: ' || st, 'code: ' || cd, CASE WHEN trim(stderr) <> '' THEN 'stderr: ' || stderr END) END, 4000) AS outcome
  FROM judged
  WHERE NOT regexp_matches(kind, '^(system|developer|custom|memory|memory_context)(_|$)') AND lower(coalesce(status, '')) NOT IN ('partial', 'aborted', 'incomplete') AND NOT coalesce(aborted, false)
    AND NOT coalesce(regexp_matches(custom_type, '(?i)memory|context|system|developer'), false) AND r NOT IN ('system', 'developer', 'custom', 'memory', 'memory_context', 'context')
), chosen AS (
  SELECT session_id, entry_id, position, CASE WHEN call THEN 'tool_call' WHEN spoken THEN r WHEN failed THEN 'tool_error' ELSE 'tool_result' END AS event_kind,
    CASE WHEN call THEN NULL WHEN spoken THEN left(text, 16000) WHEN outcome <> '' THEN outcome END AS text,
    CASE WHEN call OR NOT spoken THEN name END AS tool_name, CASE WHEN call OR (NOT spoken AND failed) THEN left(arguments, 2000) END AS tool_args
  FROM open_
  WHERE CASE WHEN call THEN NOT regexp_matches(part_type, '(?i)^(thinking|reasoning|signature|thought|redacted_thinking)$') AND NOT own
             WHEN spoken THEN NOT regexp_matches(part_type, '(?i)^(thinking|reasoning|signature|thought|redacted_thinking)$') AND coalesce(text, '') <> '' AND NOT wrapped
             ELSE NOT own AND NOT wrapped AND (failed OR outcome <> '') END
), selected AS (SELECT *, CASE WHEN event_kind = 'tool_error' THEN left(sha256(nfc_normalize(text)), 32) END AS error_fingerprint FROM chosen)"""


@query("s1_entry_scan", with_(ENTRIES) + f"SELECT session_id, CAST(CASE WHEN bool_and({_SAFE}) THEN count(*) ELSE 0 END AS BIGINT) AS n_read, count(*) FILTER (NOT {_SAFE}) AS invalid FROM entries GROUP BY session_id")
def s1_entry_scan(spark, sf_dir):
    """What is read of each session; one unsafe id quarantines its batch."""
    entries = rec.entries(spark, sf_dir)
    read, audit = op.entry_scan(entries)
    counts = read.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_read"))
    sessions = entries.select("session_id").distinct()
    return sessions.join(counts, "session_id", "left").join(audit, "session_id", "left").select("session_id", F.coalesce("n_read", F.lit(0)).alias("n_read"), F.coalesce("invalid", F.lit(0)).alias("invalid"))


_TAILS = """
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 AS place FROM entries),
tails AS (
  SELECT session_id, CASE WHEN any_value(conv_id) % 3 = 0 THEN 0 WHEN any_value(conv_id) % 7 = 3 THEN 99 ELSE 2 END AS tail_count,
    CASE WHEN any_value(conv_id) % 5 = 2 THEN 'other' ELSE arg_max(entry_id, place) FILTER (place < 2) END AS tail_entry_id,
    CASE WHEN any_value(conv_id) % 11 = 4 THEN 'bad' ELSE sha256('["' || string_agg(entry_id, '","' ORDER BY place) FILTER (place < 2) || '"]') END AS tail_hash
  FROM placed GROUP BY session_id
)"""


@query("s2_tail_scan", with_(ENTRIES, _TAILS, """
good AS (SELECT p.session_id, count(*) AS n, arg_max(entry_id, place) AS last, sha256('["' || string_agg(entry_id, '","' ORDER BY place) || '"]') AS hash FROM placed p JOIN tails t USING (session_id) WHERE place < tail_count GROUP BY p.session_id)""") + "SELECT p.session_id, p.entry_id, p.place FROM placed p JOIN tails t USING (session_id) LEFT JOIN good g USING (session_id) WHERE p.place >= t.tail_count AND (t.tail_count = 0 OR (g.n = t.tail_count AND g.last = t.tail_entry_id AND g.hash = t.tail_hash))")
def s2_tail_scan(spark, sf_dir):
    """Entries behind each session's tail; none where count, last entry or prefix hash do not match."""
    entries = rec.entries(spark, sf_dir)
    first = entries.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("position")) - 1).filter("place < 2")
    held = first.groupBy("session_id").agg(F.first("conv_id").alias("c"), F.array_sort(F.collect_list(F.struct("place", "entry_id"))).alias("e"))
    tails = held.select(
        "session_id",
        F.when(F.col("c") % 3 == 0, 0).when(F.col("c") % 7 == 3, 99).otherwise(2).alias("tail_count"),
        F.when(F.col("c") % 5 == 2, "other").otherwise(F.element_at("e", -1)["entry_id"]).alias("tail_entry_id"),
        F.when(F.col("c") % 11 == 4, "bad").otherwise(op.prefix_hash(F.col("e.entry_id"))).alias("tail_hash"),
    )
    return op.after_tail(entries, tails).select("session_id", "entry_id", "place")


@query("f12_capture", with_(ENTRIES, SELECTED) + "SELECT session_id, position, event_kind, tool_name, tool_args, error_fingerprint, length(text) AS n_chars FROM selected")
def f12_capture(spark, sf_dir):
    """Entries that become episodes, with the fields that each keeps."""
    return op.select_entries(rec.entries(spark, sf_dir)).select("session_id", "position", "event_kind", "tool_name", "tool_args", "error_fingerprint", F.length("text").cast("long").alias("n_chars"))


@query("f13_tool_failures", with_(ENTRIES, SELECTED) + "SELECT session_id, position, failed, cd AS code, st AS status FROM judged WHERE r = 'toolresult'")
def f13_tool_failures(spark, sf_dir):
    """Failure by flag, error, status or code, and the first status and code that are given."""
    results = rec.entries(spark, sf_dir).filter(F.lower("role").isin(*op.TOOL_ROLES))
    return results.select("session_id", "position", op.tool_failed().alias("failed"), F.coalesce("code", "detail_code").alias("code"), F.coalesce("status", "detail_status").alias("status"))


@query("p1_projections", with_(ENTRIES, SELECTED) + """
SELECT session_id, position, concat_ws(chr(10), 'event:' || event_kind, 'tool:' || tool_name, 'text:' || text, 'tool_args:' || tool_args, CASE WHEN error_fingerprint IS NOT NULL THEN 'error_fingerprint:present' END) AS semantic,
  CASE WHEN trim(text) <> '' THEN text WHEN tool_name IS NOT NULL THEN CASE WHEN event_kind = 'tool_error' THEN 'Tool error: ' ELSE 'Tool: ' END || tool_name ELSE 'Memory event: ' || event_kind END AS safe_text,
  concat_ws(' ', text, tool_name, tool_args, error_fingerprint) AS exact FROM selected""")
def p1_projections(spark, sf_dir):
    """The semantic, safe and searchable text of each captured episode."""
    from palimpsest.operators.retrieval import exact_text

    chosen = op.select_entries(rec.entries(spark, sf_dir)).withColumns({"record_type": F.lit("episode"), "resolution": F.lit(None).cast("string"), "subject": F.lit(None).cast("string"), "predicate": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    return chosen.select("session_id", "position", op.semantic_text().alias("semantic"), op.safe_text().alias("safe_text"), exact_text().alias("exact"))


@query("w4_session_sequence", with_(ENTRIES) + "SELECT session_id, position, CAST(CASE WHEN place <= 65535 THEN place * 65536 + position % 3 END AS BIGINT) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY position) - 1 + conv_id % 4 * 30000 AS place FROM entries)")
def w4_session_sequence(spark, sf_dir):
    """Causal sequence of each entry's part behind a tail; null beyond the range."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("position")).cast("long") - 1
    return rec.entries(spark, sf_dir).withColumn("place", place).select("session_id", "position", op.sequence(F.col("place"), F.col("position") % 3, F.col("conv_id") % 4 * 30_000).alias("sequence"))


_MARKERS = {
    "conv_id": "conv_id",
    "style": "CASE WHEN conv_id % 2 = 0 THEN 'depth' ELSE 'parent' END",
    "header_depth": "CASE WHEN conv_id % 7 = 1 THEN '2' WHEN conv_id % 7 = 2 THEN 'x' WHEN conv_id % 7 = 3 THEN '0' WHEN conv_id % 7 = 4 THEN '1001' END",
    "env_depth": "CASE WHEN conv_id % 5 = 1 THEN '2' WHEN conv_id % 5 = 2 THEN '0' WHEN conv_id % 5 = 3 THEN '-1' END",
    "parent": "CASE WHEN conv_id % 3 = 1 THEN 's0' END",
    "child_flag": "CASE WHEN conv_id % 11 = 1 THEN '1' WHEN conv_id % 11 = 2 THEN '0' WHEN conv_id % 11 = 3 THEN 'yes' END",
}
_RESOLVED = """
n AS (SELECT DISTINCT *, CASE WHEN regexp_matches(header_depth, '^[0-9]{1,4}$') AND try_cast(header_depth AS INT) <= 1000 THEN try_cast(header_depth AS INT) END AS h,
  CASE WHEN regexp_matches(env_depth, '^[0-9]{1,4}$') AND try_cast(env_depth AS INT) <= 1000 THEN try_cast(env_depth AS INT) END AS e FROM markers),
f AS (SELECT *, coalesce(child_flag = '1', false) OR coalesce(e > 0, false) OR parent IS NOT NULL AS flagged FROM n),
v AS (SELECT *, CASE WHEN style = 'depth' THEN (header_depth IS NULL OR h IS NOT NULL) AND (env_depth IS NULL OR e IS NOT NULL) AND (h IS NULL OR e IS NULL OR h = e)
  ELSE (env_depth IS NULL OR e IS NOT NULL) AND (child_flag IS NULL OR child_flag IN ('0', '1')) AND NOT (coalesce(child_flag = '0', false) AND flagged) AND NOT (coalesce(e = 0, false) AND flagged) END AS valid,
  CASE WHEN style = 'depth' THEN coalesce(h, e, 0) > 0 ELSE flagged END AS marked, CASE WHEN style = 'depth' THEN coalesce(h, e, 0) WHEN flagged THEN greatest(1, coalesce(e, 1)) ELSE 0 END AS d FROM f)"""


def _marked(spark, sf_dir):
    rows = rec.derived(spark, sf_dir, "conversations", _MARKERS).distinct()
    return rows.withColumn("m", op.resolve_marker(*(F.col(c) for c in ("style", "header_depth", "env_depth", "parent", "child_flag"))))


@query("x28_agent_role", with_(rec.cte("markers", "conversations", _MARKERS), _RESOLVED) + "SELECT conv_id, CASE WHEN marked OR NOT valid THEN 'child' ELSE 'root' END AS agent_role, CAST(CASE WHEN NOT valid AND NOT marked THEN greatest(1, d) ELSE d END AS BIGINT) AS depth, valid, valid AND NOT marked AS root_work FROM v")
def x28_agent_role(spark, sf_dir):
    """Root or child, depth and validity, from markers that may contradict each other."""
    return _marked(spark, sf_dir).select("conv_id", F.col("m.role").alias("agent_role"), "m.depth", "m.valid", "m.root_work")


@query("a13_lifecycle", with_(rec.cte("markers", "conversations", _MARKERS), _RESOLVED, "t AS (SELECT conv_id, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (turn % 4 = 3) AS calls FROM conversations GROUP BY conv_id)") + "SELECT conv_id, turns, calls, CASE WHEN NOT (valid AND NOT marked) THEN 'child' WHEN conv_id % 8 = 6 THEN 'persist_only' WHEN conv_id % 6 = 4 OR turns >= 3 OR calls >= 2 THEN 'run' ELSE 'disabled' END AS trigger FROM t JOIN v USING (conv_id)")
def a13_lifecycle(spark, sf_dir):
    """A13, ST7: turns and calls of each session, and what a lifecycle event sets off."""
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.count_if(F.col("turn") % 4 == 3).alias("calls"))
    rows = sums.join(_marked(spark, sf_dir).select("conv_id", "m.root_work"), "conv_id")
    c = F.col("conv_id")
    return rows.select("conv_id", "turns", "calls", op.curation_trigger(F.col("root_work"), F.col("turns"), F.col("calls"), c % 6 == 4, c % 8 == 6, 3, 2).alias("trigger"))


@query("a11_audit", with_(ENTRIES, SELECTED) + f"SELECT category, least(count(DISTINCT qid), 20000) AS n FROM (SELECT 'invalid_entry' AS category, session_id AS qid FROM entries WHERE NOT {_SAFE} UNION ALL SELECT 'redaction', entry_id FROM judged WHERE wrapped) GROUP BY category")
def a11_audit(spark, sf_dir):
    """Quarantined entries by category, each once, up to a bound."""
    entries = rec.entries(spark, sf_dir)
    invalid = entries.filter(~op.safe_id(F.col("entry_id"))).select(F.lit("invalid_entry").alias("category"), F.col("session_id").alias("quarantine_id"))
    wrapped = entries.filter(F.col("text").rlike(op.WRAPPER)).select(F.lit("redaction").alias("category"), F.col("entry_id").alias("quarantine_id"))
    return op.audit_counts(invalid.unionByName(wrapped))
