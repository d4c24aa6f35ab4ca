"""Typed memory records, derived from the driver's tables, and the same as DuckDB SQL.

Each source is one DataFrame with a fixed schema; nothing is inferred at run time. Times
are milliseconds since 1970 (long), so no session time zone enters a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MS = 86_400_000
BASE_MS = 1_704_067_200_000
NOW_MS = BASE_MS + 20 * DAY_MS
#: Allowed lateness, and the window in which two orders are a tie.
SKEW_MS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode for each logged turn."""
    c = table(spark, sf_dir, "conversations")
    event = F.lit(BASE_MS) + F.col("conv_id") * 600_000 + F.col("turn") * 1000
    return c.select(
        F.concat(F.lit("ep-"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.concat(F.lit("s"), "conv_id").alias("session_id"),
        "conv_id",
        "turn",
        (F.col("turn") * 65_536).alias("session_sequence"),
        F.col("role").alias("event_kind"),
        "text",
        F.when(F.col("conv_id") % 7 == 0, "beta").otherwise("alpha").alias("owner_host"),
        F.when(F.col("conv_id") % 11 != 0, F.concat(F.lit("p"), F.col("conv_id") % 5)).alias("project_id"),
        F.when(F.col("turn") % 13 == 5, "deleted").otherwise("active").alias("status"),
        F.when(F.col("conv_id") % 17 == 3, "rejected").otherwise("passed").alias("secret_scan"),
        F.when(F.col("conv_id") % 9 == 4, 0).otherwise(1).cast("long").alias("privacy_epoch"),
        F.concat(F.lit("pol"), F.col("conv_id") % 4).alias("processing_policy_id"),
        event.alias("event_at"),
        (event + 5000).alias("created_at"),
        F.when(F.col("conv_id") % 6 == 0, event + DAY_MS * (F.col("conv_id") % 40)).alias("expires_at"),
        F.when(F.col("turn") % 4 == 3, F.concat(F.lit("tool"), F.col("conv_id") % 3)).alias("tool_name"),
    )


EPISODES = f"""
episodes AS (
  SELECT 'ep-' || conv_id || '-' || turn AS id, 's' || conv_id AS session_id, conv_id, turn, turn * 65536 AS session_sequence,
    role AS event_kind, text, CASE WHEN conv_id % 7 = 0 THEN 'beta' ELSE 'alpha' END AS owner_host,
    CASE WHEN conv_id % 11 <> 0 THEN 'p' || (conv_id % 5) END AS project_id,
    CASE WHEN turn % 13 = 5 THEN 'deleted' ELSE 'active' END AS status,
    CASE WHEN conv_id % 17 = 3 THEN 'rejected' ELSE 'passed' END AS secret_scan,
    CAST(CASE WHEN conv_id % 9 = 4 THEN 0 ELSE 1 END AS BIGINT) AS privacy_epoch,
    'pol' || (conv_id % 4) AS processing_policy_id,
    {BASE_MS} + conv_id * 600000 + turn * 1000 AS event_at,
    {BASE_MS} + conv_id * 600000 + turn * 1000 + 5000 AS created_at,
    CASE WHEN conv_id % 6 = 0 THEN {BASE_MS} + conv_id * 600000 + turn * 1000 + {DAY_MS} * (conv_id % 40) END AS expires_at,
    CASE WHEN turn % 4 = 3 THEN 'tool' || (conv_id % 3) END AS tool_name
  FROM conversations
)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curated observation for each event: the user's state becomes the event's type."""
    return observations_of(table(spark, sf_dir, "events"))


def observations_of(e: DataFrame) -> DataFrame:
    """The observations of a frame of events, which may be a stream."""
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(
        "event_id",
        F.concat(F.lit("obs-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"),
        F.concat(F.lit("state:"), "user_id").alias("state_key"),
        F.concat(F.lit("content:"), "event_type").alias("content_id"),
        "user_id",
        "event_type",
        at.alias("effective_at"),
        (at + (F.col("event_id") % 7) * 1000).alias("created_at"),
        F.when(F.col("user_id") % 3 == 0, "global").otherwise("project").alias("scope"),
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("project_id"),
        F.lit(1).cast("long").alias("policy_epoch"),
        F.concat(F.lit("ep-"), F.col("event_id") % 100, F.lit("-"), F.col("event_id") % 3).alias("evidence_id"),
        F.concat(F.lit("pol"), F.col("user_id") % 4).alias("processing_policy_id"),
        "value",
    )


OBSERVATIONS = """
observations AS (
  SELECT event_id, 'obs-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, 'state:' || user_id AS state_key, 'content:' || event_type AS content_id,
    user_id, event_type, epoch_us(ts) // 1000 AS effective_at, epoch_us(ts) // 1000 + (event_id % 7) * 1000 AS created_at,
    CASE WHEN user_id % 3 = 0 THEN 'global' ELSE 'project' END AS scope, 'p' || (user_id % 5) AS project_id,
    CAST(1 AS BIGINT) AS policy_epoch, 'ep-' || (event_id % 100) || '-' || (event_id % 3) AS evidence_id,
    'pol' || (user_id % 4) AS processing_policy_id, value
  FROM events
)"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One processing policy for each supplier."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("pol"), F.col("s_suppkey") - 1).alias("policy_id"),
        F.lit("alpha").alias("owner_host"),
        F.when(F.col("s_suppkey") % 5 == 0, "local").otherwise("eu").alias("residency"),
        F.lit("memory").alias("data_use"),
        F.concat(F.lit("store"), F.col("s_nationkey") % 2).alias("store_id"),
        F.concat(F.lit("embed"), F.col("s_nationkey") % 3).alias("embedding_id"),
        F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("llm"), F.col("s_nationkey") % 2)).alias("llm_id"),
        (F.col("s_suppkey") % 4 != 0).alias("allow_replay"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit(BASE_MS) + F.col("s_suppkey") * DAY_MS).alias("expires_at"),
        F.concat(F.lit("origin"), F.col("s_nationkey") % 2).alias("origin"),
    )


POLICIES = f"""
policies AS (
  SELECT 'pol' || (s_suppkey - 1) AS policy_id, 'alpha' AS owner_host, CASE WHEN s_suppkey % 5 = 0 THEN 'local' ELSE 'eu' END AS residency,
    'memory' AS data_use, 'store' || (s_nationkey % 2) AS store_id, 'embed' || (s_nationkey % 3) AS embedding_id,
    CASE WHEN s_suppkey % 7 <> 0 THEN 'llm' || (s_nationkey % 2) END AS llm_id, s_suppkey % 4 <> 0 AS allow_replay, CASE WHEN s_suppkey % 3 = 0 THEN {BASE_MS} + s_suppkey * {DAY_MS} END AS expires_at,
    'origin' || (s_nationkey % 2) AS origin
  FROM supplier
)"""


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that were forgotten: some episodes, one content, some states."""
    ep = episodes(spark, sf_dir).filter("conv_id % 23 = 1").select(F.lit("occurrence").alias("scope"), F.col("id").alias("target_id"))
    users = table(spark, sf_dir, "events").filter("user_id % 31 = 2").select(F.lit("state").alias("scope"), F.concat(F.lit("state:"), "user_id").alias("target_id")).distinct()
    return ep.unionByName(users)


TOMBSTONES = """
tombstones AS (
  SELECT 'occurrence' AS scope, id AS target_id FROM episodes WHERE conv_id % 23 = 1
  UNION ALL SELECT DISTINCT 'state', 'state:' || user_id FROM events WHERE user_id % 31 = 2
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each order, with its lease."""
    o = table(spark, sf_dir, "orders")
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("producer-"), F.col("o_custkey") % 50).alias("producer_id"),
        at.alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "accepted").when(F.col("o_orderkey") % 3 == 0, "released").otherwise("leased").alias("state"),
        (F.col("o_orderkey") % 5 + 1).alias("fencing_token"),
        (F.col("o_orderkey") % 4 + 1).alias("version"),
        (at + (F.col("o_orderkey") % 9) * DAY_MS).alias("lease_expires_at"),
        (F.col("o_orderkey") % 6).alias("attempts"),
        F.col("o_totalprice").alias("bytes"),
    )


JOBS = f"""
jobs AS (
  SELECT o_orderkey AS job_id, 'producer-' || (o_custkey % 50) AS producer_id, epoch_us(o_orderdate) // 1000 AS created_at,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'accepted' WHEN o_orderkey % 3 = 0 THEN 'released' ELSE 'leased' END AS state,
    o_orderkey % 5 + 1 AS fencing_token, o_orderkey % 4 + 1 AS version, epoch_us(o_orderdate) // 1000 + (o_orderkey % 9) * {DAY_MS} AS lease_expires_at,
    o_orderkey % 6 AS attempts, o_totalprice AS bytes
  FROM orders
)"""


def derived(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    """Columns over a table by SQL expressions that Spark and DuckDB read alike."""
    return table(spark, sf_dir, name).selectExpr(*[f"{sql} AS {column}" for column, sql in columns.items()])


def cte(name: str, table_name: str, columns: dict[str, str]) -> str:
    """The same columns as a common table expression for the oracle."""
    listed = ", ".join(f"{sql} AS {column}" for column, sql in columns.items())
    return f"\n{name} AS (SELECT {listed} FROM {table_name})"


#: A session's log entries, as a host writes them: kinds, roles, parts and outcomes of each.
ENTRY_COLUMNS = {
    "session_id": "'s' || conv_id",
    "conv_id": "conv_id",
    "position": "turn",
    "entry_id": "CASE WHEN conv_id % 29 = 7 AND turn = 1 THEN 'secret entry ' || conv_id WHEN conv_id % 31 = 8 AND turn = 2 THEN '' ELSE 'e-' || conv_id || '-' || turn END",
    "entry_type": "CASE WHEN turn % 19 = 11 THEN 'Custom_note' WHEN turn % 23 = 4 AND conv_id % 3 = 0 THEN 'memory' ELSE 'message' END",
    "role": "CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'toolResult' ELSE role END",
    "part_type": "CASE WHEN conv_id % 6 = 1 AND turn % 5 = 3 THEN 'Thinking' WHEN role = 'assistant' AND turn % 4 = 1 THEN 'toolCall' ELSE 'text' END",
    "text": "CASE WHEN conv_id % 13 = 4 AND turn = 2 THEN '[memory-context] ' || text WHEN conv_id % 17 = 5 AND turn = 1 THEN '' ELSE text END",
    "name": "CASE WHEN role = 'assistant' AND turn % 2 = 1 AND conv_id % 5 = 0 THEN 'memory_search' WHEN role = 'assistant' AND turn % 2 = 1 THEN 'tool' || (conv_id % 3) END",
    "arguments": "CASE WHEN role = 'assistant' AND turn % 2 = 1 AND conv_id % 4 <> 2 THEN '{\"n\":' || turn || '}' END",
    "status": "CASE WHEN conv_id % 8 = 5 AND turn % 4 = 3 THEN 'Timed-Out' WHEN conv_id % 9 = 2 AND turn % 7 = 6 THEN 'Partial' WHEN conv_id % 5 = 1 THEN 'ok' END",
    "aborted": "conv_id % 27 = 13 AND turn = 3",
    "is_error": "conv_id % 10 = 9 AND turn % 2 = 1",
    "error": "CASE WHEN conv_id % 12 = 5 THEN '  ' WHEN conv_id % 12 = 6 THEN 'boom' END",
    "code": "CASE WHEN conv_id % 3 = 1 THEN CAST((conv_id + turn) % 3 AS BIGINT) END",
    "detail_code": "CASE WHEN conv_id % 3 = 2 THEN CAST((conv_id + turn) % 4 AS BIGINT) END",
    "detail_status": "CASE WHEN conv_id % 11 = 3 THEN 'denied' END",
    "stderr": "CASE WHEN conv_id % 4 = 1 THEN 'warn' WHEN conv_id % 4 = 3 THEN ' ' END",
    "custom_type": "CASE WHEN conv_id % 25 = 6 AND turn = 2 THEN 'my-context' END",
}
ENTRIES = cte("entries", "conversations", ENTRY_COLUMNS)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "conversations", ENTRY_COLUMNS)


#: Records of several types under one envelope.
_MEMORY = {
    "episode": ("conversations", {"record_type": "'episode'", "id": "'ep-' || conv_id || '-' || turn", "owner_host": "CASE WHEN conv_id % 7 = 0 THEN 'beta' ELSE 'alpha' END", "project_id": "'p' || (conv_id % 5)", "status": "CASE WHEN turn % 13 = 5 THEN 'deleted' ELSE 'active' END", "secret_scan": "CASE WHEN conv_id % 17 = 3 THEN 'rejected' ELSE 'passed' END", "privacy_epoch": "CAST(CASE WHEN conv_id % 9 = 4 THEN 0 ELSE 1 END AS BIGINT)", "processing_policy_id": "'pol' || (conv_id % 4)", "expires_at": f"CASE WHEN conv_id % 6 = 0 THEN {BASE_MS} + {DAY_MS} * (conv_id % 40) END"}),
    "curated_memory": ("events", {"record_type": "'curated_memory'", "id": "'obs-' || event_id", "owner_host": "'alpha'", "project_id": "'p' || (user_id % 5)", "status": "'active'", "secret_scan": "'passed'", "privacy_epoch": "CAST(1 AS BIGINT)", "processing_policy_id": "'pol' || (user_id % 4)", "expires_at": f"CASE WHEN event_id % 5 = 0 THEN {BASE_MS} + {DAY_MS} * (event_id % 40) END"}),
    "lease": ("orders", {"record_type": "'lease'", "id": "'lease-' || o_orderkey", "owner_host": "CASE WHEN o_orderkey % 8 = 0 THEN 'beta' ELSE 'alpha' END", "project_id": "'p' || (o_custkey % 5)", "status": "'active'", "secret_scan": "'passed'", "privacy_epoch": "CAST(o_orderkey % 2 AS BIGINT)", "processing_policy_id": "'pol' || (o_custkey % 4)", "expires_at": f"{BASE_MS} - {DAY_MS} * (o_orderkey % 9)"}),
    "tombstone": ("customer", {"record_type": "'tombstone'", "id": "'tomb-' || c_custkey", "owner_host": "'alpha'", "project_id": "'p0'", "status": "'active'", "secret_scan": "'passed'", "privacy_epoch": "CAST(1 AS BIGINT)", "processing_policy_id": "'pol0'", "expires_at": "CAST(NULL AS BIGINT)"}),
}
MEMORY = "\nmemory AS (" + " UNION ALL ".join("SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in columns.items()) + f" FROM {name}" for name, columns in _MEMORY.values()) + ")"


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records under one envelope."""
    first, *rest = (derived(spark, sf_dir, name, columns) for name, columns in _MEMORY.values())
    for other in rest:
        first = first.unionByName(other)
    return first


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes) + "\n"


#: The records that a search reads. Each project stands for a case: in p2 some evidence belongs to another owner, in p3
#: some was deleted, p1 has forgotten records, in p4 some records' policy is unknown; p0 has none of these.
_PROJECT = {"conversations": "'p' || (conv_id % 5)", "events": "'p' || (user_id % 5)"}
_AT = {"conversations": f"{BASE_MS} + conv_id * 600000 + turn * 1000", "events": f"{BASE_MS} + event_id * 60000"}
_SEARCH_NULLS = {c: "CAST(NULL AS VARCHAR(99))" for c in ("scope", "text", "tool_name", "tool_args", "error_fingerprint", "event_kind", "subject", "predicate", "value", "resolution", "content_id", "observation_id", "state_key", "evidence", "members", "projects", "generation_id", "project_id")}
_SEARCH_COMMON = {"owner_host": "'alpha'", "project_kind": "'registered'", "status": "'active'", "secret_scan": "'passed'", "privacy_epoch": "CAST(1 AS BIGINT)", "policy_epoch": "CAST(1 AS BIGINT)", "policy_hash": "'h1'", "expires_at": "CAST(NULL AS BIGINT)"}
_EVENT_EVIDENCE = "'ep-' || (5 * (event_id % 20) + user_id % 5) || '-' || (event_id % 3)"
_SEARCH = {
    "episode": ("conversations", {
        "record_type": "'episode'", "id": "'ep-' || conv_id || '-' || turn", "project_id": _PROJECT["conversations"], "scope": "'project'", "text": "text", "event_kind": "role", "happened_at": _AT["conversations"], "created_at": f"{_AT['conversations']} + 5000",
        "owner_host": "CASE WHEN conv_id % 10 = 7 THEN 'beta' ELSE 'alpha' END", "status": "CASE WHEN conv_id % 5 = 3 AND turn = 0 THEN 'deleted' ELSE 'active' END", "project_kind": "CASE WHEN conv_id % 100 = 55 THEN 'local_only' ELSE 'registered' END",
        "processing_policy_id": "CASE WHEN conv_id % 45 = 4 THEN 'lost' WHEN conv_id % 5 = 4 THEN 'pol' || (conv_id % 4) ELSE 'pol' || (conv_id % 2) END", "tool_name": "CASE WHEN turn % 4 = 3 THEN 'tool' || (conv_id % 3) END", "expires_at": f"CASE WHEN turn % 7 = 6 THEN {BASE_MS} + {DAY_MS} * (conv_id % 40) END", "vec": "conv_id * 7 + turn",
    }),
    "curated_memory": ("events", {
        "record_type": "'curated_memory'", "id": "'obs-' || lpad(CAST(event_id AS VARCHAR(20)), 9, '0')", "project_id": _PROJECT["events"], "scope": "CASE WHEN user_id % 15 = 0 THEN 'global' ELSE 'project' END", "text": "'user ' || user_id || ' did the ' || event_type || ' there'",
        "subject": "'user'", "predicate": "'did'", "value": "event_type", "content_id": "'content:' || event_type || (event_id % 4)", "observation_id": "'obs-' || event_id", "state_key": "'state:' || user_id", "evidence": _EVENT_EVIDENCE,
        "happened_at": _AT["events"], "created_at": f"{_AT['events']} + 1000", "policy_hash": "CASE WHEN event_id % 6 = 1 THEN 'h0' ELSE 'h1' END", "processing_policy_id": "CASE WHEN user_id % 5 = 4 THEN 'pol' || (user_id % 4) ELSE 'pol' || (user_id % 2) END", "vec": "event_id",
    }),
    "curated_current": ("events", {
        "record_type": "'curated_current'", "id": "'cur-' || lpad(CAST(event_id AS VARCHAR(20)), 9, '0')", "project_id": _PROJECT["events"], "scope": "CASE WHEN user_id % 15 = 0 THEN 'global' ELSE 'project' END", "text": "'now the ' || event_type || ' of ' || user_id || ' holds there'",
        "resolution": "CASE WHEN event_id % 5 = 2 THEN 'conflict' ELSE 'resolved' END", "content_id": "'content:' || event_type || (event_id % 4)", "state_key": "'state:' || user_id", "evidence": _EVENT_EVIDENCE,
        "happened_at": _AT["events"], "created_at": f"{_AT['events']} + 2000", "policy_epoch": "CAST(CASE WHEN event_id % 9 = 4 THEN 0 ELSE 1 END AS BIGINT)", "processing_policy_id": "CASE WHEN user_id % 5 = 4 THEN 'pol' || (user_id % 4) ELSE 'pol' || (user_id % 2) END", "vec": "event_id + 3",
    }),
    # a summary above the first two turns of a conversation, and one above it and the first turn itself
    "leaf_summary": ("conversations", {
        "record_type": "'raptor_summary'", "id": "'sum1-' || conv_id", "members": "'ep-' || conv_id || '-0,ep-' || conv_id || '-1' || CASE WHEN conv_id % 40 = 21 THEN ',ep-none' ELSE '' END", "projects": _PROJECT["conversations"], "generation_id": "'g1'",
        "happened_at": _AT["conversations"], "created_at": _AT["conversations"], "processing_policy_id": "'pol' || (conv_id % 2)", "vec": "conv_id % 5",
    }),
    "top_summary": ("conversations", {
        "record_type": "'raptor_summary'", "id": "'sum2-' || conv_id", "members": "'sum1-' || conv_id || ',ep-' || conv_id || '-0'", "projects": f"CASE WHEN conv_id % 3 = 0 THEN 'p9,' ELSE '' END || {_PROJECT['conversations']}", "generation_id": "CASE WHEN conv_id % 4 = 3 THEN 'g0' ELSE 'g1' END",
        "happened_at": _AT["conversations"], "created_at": _AT["conversations"], "processing_policy_id": "'pol1'", "vec": "conv_id % 5 + 5 * (conv_id % 2)",
    }),
}
_SEARCH_FILTER = {"leaf_summary": "turn = 1", "top_summary": "turn = 1"}
SEARCH_COLUMNS = ["id", "record_type", "happened_at", "created_at", "processing_policy_id", "vec", *_SEARCH_COMMON, *_SEARCH_NULLS]
_SEARCH_SQL = " UNION ALL ".join(
    "SELECT " + ", ".join(f"{(_SEARCH_NULLS | _SEARCH_COMMON | columns)[c]} AS {c}" for c in SEARCH_COLUMNS) + f" FROM {name}" + (f" WHERE {_SEARCH_FILTER[kind]}" if kind in _SEARCH_FILTER else "") for kind, (name, columns) in _SEARCH.items()
)
SEARCH_RECORDS = f"""
flat_records AS ({_SEARCH_SQL}),
records AS (
  SELECT f.* EXCLUDE (evidence, members, projects), string_split(evidence, ',') AS evidence_ids, string_split(members, ',') AS member_ids, string_split(projects, ',') AS covered_projects, CAST(v.embedding AS DOUBLE[]) AS vector
  FROM flat_records f LEFT JOIN embeddings v ON v.vec_id = f.vec % (SELECT count(*) FROM embeddings))"""


def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes, curated records and summaries under one envelope, with vectors."""
    for name in ("conversations", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_search_{name}")
    flat = spark.sql(_SEARCH_SQL.replace(" FROM conversations", " FROM _search_conversations").replace(" FROM events", " FROM _search_events"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    size = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    placed = flat.join(F.broadcast(size), F.lit(True)).withColumn("vec_id", F.col("vec") % F.col("n_vectors"))
    lists = {"evidence_ids": "evidence", "member_ids": "members", "covered_projects": "projects"}
    return placed.withColumns({to: F.split(of, ",") for to, of in lists.items()}).join(vectors, "vec_id", "left").drop(*lists.values(), "vec", "vec_id", "n_vectors")
