"""Jobs, leases, sinks, retries and outbox queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import identity as ident
from palimpsest.operators import coordination as co
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, DAY_MS, EPISODES, JOBS, SKEW_MS, table, with_

NOW = BASE_MS - 2000 * DAY_MS
_CLAIM = f"(state = 'released' OR (state = 'leased' AND lease_expires_at + {SKEW_MS} <= {NOW}))"


@query("s11_insert_classification", with_(EPISODES) + "SELECT a.id, sha256(a.text) AS content_hash, CASE WHEN b.id IS NULL THEN 'insert' WHEN sha256(a.text) = b.content_hash THEN 'existing' ELSE 'collision' END AS outcome FROM episodes a LEFT JOIN (SELECT id, CASE WHEN turn = 1 THEN 'other' ELSE sha256(text) END AS content_hash FROM episodes WHERE conv_id % 2 = 0) b USING (id)")
def s11_insert_classification(spark, sf_dir):
    """What an insert-only write finds for each id."""
    ep = rec.episodes(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    stored = ep.filter("conv_id % 2 = 0").select("id", F.when(F.col("turn") == 1, "other").otherwise(F.col("content_hash")).alias("content_hash"))
    return co.classify_insert(ep.select("id", "content_hash"), stored)


@query("s12_latest_version", "SELECT c_custkey % 100 AS k, max(c_custkey) AS version, arg_max(c_mktsegment, c_custkey) AS state FROM customer GROUP BY 1")
def s12_latest_version(spark, sf_dir):
    """The state that versioned appends leave."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("k"), F.col("c_custkey").alias("version"), F.col("c_mktsegment").alias("state"))
    return co.latest_version(rows, "k")


@query("s12_compare_and_set", """
WITH s AS (SELECT c_custkey AS k, c_custkey % 4 AS version, c_mktsegment AS state FROM customer), p AS (SELECT c_custkey AS k, c_custkey % 3 AS expected, 'NEW' || (c_custkey % 7) AS state FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_custkey % 4, 'ZZZ' FROM customer WHERE c_custkey % 6 = 1),
b AS (SELECT k, expected, min(state) AS state FROM p GROUP BY k, expected)
SELECT s.k, CASE WHEN b.k IS NOT NULL THEN s.version + 1 ELSE s.version END AS version, coalesce(b.state, s.state) AS state, CASE WHEN b.k IS NOT NULL THEN 'applied' WHEN s.k IN (SELECT k FROM p) THEN 'stale' ELSE 'untouched' END AS outcome
FROM s LEFT JOIN b ON b.k = s.k AND b.expected = s.version""")
def s12_compare_and_set(spark, sf_dir):
    """Rows after conditional writes; of those that expect the stored version one applies."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    stored = c.select(k.alias("k"), (k % 4).alias("version"), F.col("c_mktsegment").alias("state"))
    first = c.filter("c_custkey % 5 <> 0").select(k.alias("k"), (k % 3).alias("expected"), F.concat(F.lit("NEW"), k % 7).alias("state"))
    second = c.filter("c_custkey % 6 = 1").select(k.alias("k"), (k % 4).alias("expected"), F.lit("ZZZ").alias("state"))
    return co.compare_and_set(stored, first.unionByName(second), "k")


@query("s13_outbox_jobs", with_(EPISODES, "n AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY id) - 1) // 4 AS chunk FROM episodes)", "j AS (SELECT session_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS size, max(created_at) AS created_at, CAST(sum(strlen(text)) AS BIGINT) AS bytes, 'job:' || sha256('[\"' || session_id || '\",\"' || string_agg(id, '|' ORDER BY id) || '\"]') AS job_id FROM n GROUP BY 1, 2)") + "SELECT *, sha256(concat_ws('|', job_id, session_id, chunk, size, created_at, bytes)) AS audit_hash FROM j")
def s13_outbox_jobs(spark, sf_dir):
    """Deterministic jobs of bounded size from sorted members, dated by the latest, each with an audit hash."""
    return co.outbox_jobs(rec.episodes(spark, sf_dir), 4)


@query("x12_fingerprints", "SELECT doc_id, left(sha256(text), 32) AS fingerprint FROM documents")
def x12_fingerprints(spark, sf_dir):
    """Error fingerprints."""
    from palimpsest.functions.text import fingerprint

    return table(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


@query("x18_point_ids", """SELECT job_id, left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || lower(printf('%02x', (CAST('0x' || substr(d, 17, 2) AS INT) & 63) | 128)) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS point_id FROM (SELECT o_orderkey AS job_id, sha256('job:' || o_orderkey) AS d FROM orders)""")
def x18_point_ids(spark, sf_dir):
    """Deterministic point ids."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), ident.uuid_from_digest(F.sha2(F.concat(F.lit("job:"), "o_orderkey"), 256)).alias("point_id"))


@query("x20_retry_delay", with_(JOBS) + """
SELECT job_id, CAST(greatest(1, least(600000, floor(least(600000, 1000 * pow(2, least(30, greatest(0, attempts - 1)))) * (0.5 + CAST('0x' || left(sha256('{"attempts":' || attempts || ',"jobId":"' || job_id || '"}'), 8) AS BIGINT) / 4294967295.0::DOUBLE * 0.5)))) AS BIGINT) AS delay FROM jobs""")
def x20_retry_delay(spark, sf_dir):
    """Exponential delay with a fixed jitter."""
    return rec.jobs(spark, sf_dir).select("job_id", co.retry_delay(F.col("job_id").cast("string"), F.col("attempts"), 1000, 600_000).alias("delay"))


_RESUMED = f"""
p AS (SELECT *, job_id % 7 = 3 AS tombstoned, CASE WHEN job_id % 10 = 4 THEN NULL ELSE state END AS now FROM jobs),
r AS (SELECT *, CASE WHEN now = 'accepted' AND NOT tombstoned THEN 1 WHEN now IN ('leased', 'released') AND NOT tombstoned THEN 2 WHEN now IS NULL AND NOT tombstoned THEN 3 WHEN now = 'accepted' THEN 4 END AS rank FROM p),
b AS (SELECT producer_id, job_id, rank, row_number() OVER (PARTITION BY producer_id ORDER BY rank, created_at, job_id) AS k FROM r WHERE rank IS NOT NULL),
e AS (SELECT producer_id, CASE WHEN bool_or(now IN ('leased', 'released')) THEN 'tombstoned-durable-job' WHEN bool_and(tombstoned) THEN 'all-tombstoned' ELSE 'already-covered' END AS terminal FROM r GROUP BY producer_id)"""


@query("c8_resume", with_(JOBS, _RESUMED) + "SELECT e.producer_id, b.job_id, b.rank, CASE WHEN b.job_id IS NULL THEN terminal END AS terminal FROM e LEFT JOIN b ON b.producer_id = e.producer_id AND k = 1")
def c8_resume(spark, sf_dir):
    """What each producer takes up after a crash: accepted, then durable, then planned, then blocked work, or why there is none."""
    k = F.col("job_id")
    jobs = rec.jobs(spark, sf_dir).withColumns({"tombstoned": k % 7 == 3, "state": F.when(k % 10 != 4, F.col("state"))})
    return co.resume_job(jobs)


@query("a12_outbox_status", with_(JOBS) + "SELECT producer_id, count(*) AS jobs, round(sum(bytes), 2) AS bytes, min(created_at) AS oldest, CAST(sum(attempts) AS BIGINT) AS attempts FROM jobs WHERE state <> 'completed' GROUP BY producer_id")
def a12_outbox_status(spark, sf_dir):
    """Pending jobs of each producer."""
    return rec.jobs(spark, sf_dir).filter("state <> 'completed'").groupBy("producer_id").agg(F.count(F.lit(1)).alias("jobs"), F.round(F.sum("bytes"), 2).alias("bytes"), F.min("created_at").alias("oldest"), F.sum("attempts").alias("attempts"))


@query("c10_recovery", with_(JOBS) + f"SELECT producer_id, count(*) FILTER (state <> 'completed') AS pending, max(created_at) AS heartbeat, max(created_at) + {DAY_MS} + {SKEW_MS} <= {NOW} AS stale FROM jobs GROUP BY producer_id HAVING count(*) FILTER (state <> 'completed') > 0")
def c10_recovery(spark, sf_dir):
    """ST12, C10: producers with pending work, and whether another may adopt it."""
    sums = rec.jobs(spark, sf_dir).groupBy("producer_id").agg(F.count_if(F.col("state") != "completed").alias("pending"), F.max("created_at").alias("heartbeat"))
    return sums.filter("pending > 0").withColumn("stale", F.col("heartbeat") + DAY_MS + SKEW_MS <= NOW)


@query("w7_fair_order", with_(JOBS, "n AS (SELECT producer_id, job_id, row_number() OVER (ORDER BY producer_id, job_id) - 1 AS k, count(*) OVER () AS t FROM jobs WHERE state = 'leased')") + "SELECT producer_id, job_id, (k - 1037 % t + t) % t AS turn FROM n WHERE (k - 1037 % t + t) % t < 200")
def w7_fair_order(spark, sf_dir):
    """W7, ST2: the next jobs of a cycle through all producers, from a cursor that turns."""
    return co.fair_order(rec.jobs(spark, sf_dir).filter("state = 'leased'"), "producer_id", "job_id", 1037, 200)[0]


@query("w10_admission", with_(JOBS, "i AS (SELECT producer_id, job_id, CAST(floor(bytes) AS BIGINT) AS size, row_number() OVER (PARTITION BY producer_id ORDER BY job_id) AS k FROM jobs)", """
g(producer_id, job_id, k, jobs, used, admitted) AS (
  SELECT producer_id, job_id, k, CAST(CASE WHEN size <= 600000 THEN 1 ELSE 0 END AS BIGINT), CAST(CASE WHEN size <= 600000 THEN size ELSE 0 END AS BIGINT), size <= 600000 FROM i WHERE k = 1
  UNION ALL SELECT i.producer_id, i.job_id, i.k, CASE WHEN jobs + 1 <= 6 AND used + size <= 600000 THEN jobs + 1 ELSE jobs END, CASE WHEN jobs + 1 <= 6 AND used + size <= 600000 THEN used + size ELSE used END, jobs + 1 <= 6 AND used + size <= 600000
  FROM g JOIN i ON i.producer_id = g.producer_id AND i.k = g.k + 1)""", recursive=True) + "SELECT producer_id, job_id, admitted FROM g")
def w10_admission(spark, sf_dir):
    """Reservations admitted in id order under caps of jobs and bytes; one that does not fit is passed over."""
    rows = rec.jobs(spark, sf_dir).select("producer_id", "job_id", F.floor("bytes").cast("long").alias("size"))
    return co.admit(rows, "producer_id", "job_id", "size", 6, 600_000)


@query("w8_token_partition", with_(EPISODES, "i AS (SELECT session_id, id, greatest(1, length(text) // 4) AS size, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM episodes)", """
g(session_id, id, k, part, used) AS (
  SELECT session_id, id, k, CAST(CASE WHEN size >= 100 THEN 0 ELSE 0 END AS BIGINT), CAST(CASE WHEN size >= 100 THEN -1 ELSE size END AS BIGINT) FROM i WHERE k = 1
  UNION ALL
  SELECT i.session_id, i.id, i.k,
    CASE WHEN g.used = -1 THEN g.part + 1 WHEN g.used > 0 AND g.used + size > 100 THEN g.part + 1 ELSE g.part END,
    CASE WHEN size >= 100 THEN -1 WHEN g.used = -1 OR g.used + size > 100 THEN size ELSE g.used + size END
  FROM g JOIN i ON i.session_id = g.session_id AND i.k = g.k + 1)""", recursive=True) + "SELECT session_id, id, part FROM g")
def w8_token_partition(spark, sf_dir):
    """Consecutive members packed into token budgets."""
    items = rec.episodes(spark, sf_dir).select("session_id", "id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("size"))
    return co.greedy_pack(items, "session_id", "id", "size", 100)


@query("st1_capture_stream", with_(EPISODES) + "SELECT id FROM episodes WHERE event_kind IN ('user', 'assistant')")
def st1_capture_stream(spark, sf_dir):
    """ST1: episodes captured by a stream that may see entries twice; the ids seen are the stream's state."""
    from palimpsest.streaming.capture import capture

    return capture(spark, sf_dir)


@query("st5_sweep", with_(EPISODES) + "SELECT id FROM episodes WHERE event_kind IN ('user', 'assistant') AND NOT (turn % 2 = 0 AND conv_id % 3 <> 1)")
def st5_sweep(spark, sf_dir):
    """ST5: what a sweep over all entries finds that the sink lacks, however late or far behind the cursor it came."""
    from palimpsest.streaming.capture import captured, sweep

    entries = table(spark, sf_dir, "conversations")
    sink = captured(entries.filter("turn % 2 = 0 AND conv_id % 3 <> 1"))
    return sweep(captured(entries), sink).select("id")
