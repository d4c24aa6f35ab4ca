"""Streams with keyed state, conditional commits and the outbox as a source, run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import coordination as co
from palimpsest.plans.leases import LEASE_MS
from palimpsest.plans.registry import ORACLE_SQL, query
from palimpsest.sources import records as rec
from palimpsest.sources.records import EPISODES, SKEW_MS, table, with_
from palimpsest.sources.shared import new_folder
from palimpsest.streaming import outbox, state
from palimpsest.streaming.ledger import Ledger


@query("st9_stream_current", ORACLE_SQL["st9_fold_current"])
def st9_stream_current(spark, sf_dir):
    """ST9, C6: the current value of each state, as a stream that keeps one value a state and no history."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    said = state.run(state.stateful(rec.observations_of(events), "state_key", state.Current(SKEW_MS)), new_folder(spark, "current"))
    last = said.groupBy("state_key").agg(F.max_by(F.struct("kind", "content", "at", "members", "version"), "version").alias("v")).select("state_key", "v.*")
    return last.withColumn("members", F.array_join("members", ","))


#: An order is a job: claimed when it is placed, its lease then renewed, released or completed by what the order came to.
_AT = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ))"
_STEPS = f"""array(
  named_struct('seq', 0L, 'kind', 'claim', 'owner_id', 'n1', 'held_version', 0L, 'wait', 0L),
  named_struct('seq', 1L, 'kind', CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'release' ELSE 'renew' END, 'owner_id', 'n1', 'held_version', CASE WHEN o_orderkey % 4 = 3 THEN 2L ELSE 1L END, 'wait', CASE WHEN o_orderkey % 5 = 2 THEN {LEASE_MS}L ELSE 1000L END),
  CASE WHEN o_orderkey % 2 = 0 THEN named_struct('seq', 2L, 'kind', 'claim', 'owner_id', 'n2', 'held_version', 0L, 'wait', CASE WHEN o_orderkey % 3 = 0 THEN {3 * LEASE_MS + SKEW_MS}L ELSE 2000L END) END)"""


@query(
    "st8_lease_stream",
    f"""
WITH t AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000 AS at0, o_orderstatus AS s FROM orders),
two AS (SELECT *, k % 4 <> 3 AND k % 5 <> 2 AS ok, at0 + CASE WHEN k % 5 = 2 THEN {LEASE_MS} ELSE 1000 END AS at1 FROM t),
after AS (SELECT *, CASE WHEN ok AND s = 'F' THEN 'completed' WHEN ok AND s = 'P' THEN 'released' ELSE 'leased' END AS state, CASE WHEN ok THEN 2 ELSE 1 END AS version, CASE WHEN ok AND s NOT IN ('F', 'P') THEN at1 ELSE at0 END + {LEASE_MS} AS until FROM two),
three AS (SELECT *, at0 + CASE WHEN k % 3 = 0 THEN {3 * LEASE_MS + SKEW_MS} ELSE 2000 END AS at2 FROM after),
taken AS (SELECT *, k % 2 = 0 AND state <> 'completed' AND (state = 'released' OR until + {SKEW_MS} <= at2) AS stolen FROM three)
SELECT k AS job_id, CASE WHEN stolen THEN 'n2' ELSE 'n1' END AS owner_id, CAST(version + CASE WHEN stolen THEN 1 ELSE 0 END AS BIGINT) AS version, CAST(CASE WHEN stolen THEN 2 ELSE 1 END AS BIGINT) AS fencing_token,
  CASE WHEN stolen THEN at2 + {LEASE_MS} ELSE until END AS expires_at, CASE WHEN stolen THEN 'leased' ELSE state END AS state FROM taken""",
)
def st8_lease_stream(spark, sf_dir):
    """ST8: leases under a stream of claims, renewals, releases and completions, one state a job."""
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*")
    steps = orders.select(F.col("o_orderkey").alias("job_id"), F.expr(_AT).alias("placed"), F.inline(F.array_compact(F.expr(_STEPS))))
    events = steps.withColumns({"at": F.col("placed") + F.col("wait"), "held_fence": F.lit(1).cast("long")})
    said = state.run(state.stateful(events, "job_id", state.Leases(SKEW_MS, LEASE_MS, key="long")), new_folder(spark, "leases"))
    return said.groupBy("job_id").agg(F.max_by(F.struct("owner_id", "version", "fencing_token", "expires_at", "state"), F.struct("version", "at")).alias("v")).select("job_id", "v.*")


@query("s12_conditional_commit", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE o_orderstatus END AS content_hash, CAST(CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END AS BIGINT) AS version FROM orders")
def s12_conditional_commit(spark, sf_dir):
    """Rows inserted by one commit of a versioned table, and changed by another where they are at the version expected."""
    orders = table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    ledger = Ledger(spark, new_folder(spark, "ledger"), "id string, content_hash string, version long")
    ledger.insert_only(orders.select("id", F.col("o_orderstatus").alias("content_hash"), F.lit(1).cast("long").alias("version")))
    ledger.compare_and_set(orders.select("id", F.col("o_orderpriority").alias("content_hash"), F.lit(0).cast("long").alias("version"), (F.col("o_orderkey") % 3).alias("expected_version")))
    return ledger.read().select("id", "content_hash", "version")


_PRODUCED = """
e AS (SELECT *, 'producer-' || (conv_id % 20) AS producer_id FROM episodes),
n AS (SELECT *, (row_number() OVER (PARTITION BY producer_id ORDER BY id) - 1) // 1024 AS chunk FROM e),
j AS (SELECT producer_id, 'job:' || sha256('["' || producer_id || '","' || string_agg(id, '|' ORDER BY id) || '"]') AS job_id,
  '{"chunk":' || CAST(chunk AS BIGINT) || ',"size":' || count(*) || ',"created_at":' || max(created_at) || ',"bytes":' || CAST(sum(strlen(text)) AS BIGINT) || '}' AS payload FROM n GROUP BY producer_id, chunk)"""


@query("s13_outbox_stream", with_(EPISODES, _PRODUCED) + "SELECT producer_id, row_number() OVER (PARTITION BY producer_id ORDER BY job_id) - 1 AS sequence, job_id, payload FROM j")
def s13_outbox_stream(spark, sf_dir):
    """Jobs written to the outbox by one commit and read back as a stream, in sequence by producer."""
    produced = rec.episodes(spark, sf_dir).withColumn("session_id", F.concat(F.lit("producer-"), F.col("conv_id") % 20))
    path = new_folder(spark, "outbox")
    outbox.write_jobs(outbox.payloads(co.outbox_jobs(produced, 1024)), path)
    jobs, _ = outbox.drain(spark, path, new_folder(spark, "drained"))
    return jobs
