"""Control rows, identities, delivery and wire form."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import control as op
from palimpsest.plans.admin import CONTROL
from palimpsest.plans.admin import control as control_rows
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import DAY_MS, EPISODES, JOBS, SKEW_MS, table, with_

NOW = rec.BASE_MS - 2000 * DAY_MS


@query("s14_bootstrap", "SELECT DISTINCT 'host-' || r_name AS owner_host, CAST(0 AS BIGINT) AS version, 'active' AS state FROM region")
def s14_bootstrap(spark, sf_dir):
    """The first control row of each owner; regions stand for owners, of which there are few."""
    owners = [r[0] for r in table(spark, sf_dir, "region").select(F.concat(F.lit("host-"), "r_name")).collect()]
    return op.bootstrap(spark, owners).select("owner_host", "version", "state")


@query("st11_transitions", with_(CONTROL) + """
SELECT owner_host, version + CASE WHEN drained THEN 1 ELSE 0 END + CASE WHEN activated THEN 1 ELSE 0 END + CASE WHEN published THEN 1 ELSE 0 END + CASE WHEN barred THEN 1 ELSE 0 END AS version,
  CASE WHEN barred THEN NULL WHEN published THEN 'g-new' ELSE active_generation END AS active_generation, policy_epoch + CASE WHEN activated THEN 1 ELSE 0 END AS policy_epoch, privacy_epoch + CASE WHEN barred THEN 1 ELSE 0 END AS privacy_epoch,
  CASE WHEN activated THEN 'active' WHEN drained THEN 'draining' ELSE state END AS state
FROM (SELECT *, version + CASE WHEN drained THEN 1 ELSE 0 END + CASE WHEN activated THEN 1 ELSE 0 END = 3 AND active_generation IS NULL AS published,
    version + CASE WHEN drained THEN 1 ELSE 0 END + CASE WHEN activated THEN 1 ELSE 0 END + CASE WHEN version + CASE WHEN drained THEN 1 ELSE 0 END + CASE WHEN activated THEN 1 ELSE 0 END = 3 AND active_generation IS NULL THEN 1 ELSE 0 END = 4 AS barred
  FROM (SELECT *, version = 1 AND state = 'active' AS drained, version + CASE WHEN version = 1 AND state = 'active' THEN 1 ELSE 0 END = 2 AND (state = 'draining' OR (version = 1 AND state = 'active')) AS activated FROM control))""")
def st11_transitions(spark, sf_dir):
    """ST11, C7: a drain, an activation, a publication and a forget barrier over many control rows, each where its condition holds."""
    row = op.drain(control_rows(spark, sf_dir), 1)
    row = op.publish(op.activate(row, 2, pending=0), 3, None, "g-new")
    return op.forget_barrier(row, 4).drop("revoked")


@query("c9_snapshots", with_(CONTROL) + "SELECT owner_host FROM control WHERE NOT (version = 1 AND state = 'active')")
def c9_snapshots(spark, sf_dir):
    """Owners whose control row is the same before and after another process began to drain some."""
    before = control_rows(spark, sf_dir)
    return op.unchanged(before, op.drain(before, 1))


_FINGERPRINT = "left(sha256(lower(split_part(p, '/', 1)) || regexp_replace(p, '^[^/]*', '')), 32)"


@query("s16_projects", f"WITH f AS (SELECT page_id, url, {_FINGERPRINT} AS fingerprint FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^[^/@]*@', ''), '(\\.git)?/*$', '') AS p FROM pages)), r AS (SELECT DISTINCT fingerprint FROM f WHERE page_id % 3 = 0) SELECT page_id, fingerprint, CASE WHEN r.fingerprint IS NOT NULL THEN 'registered' ELSE 'local_only' END AS identity_kind, CASE WHEN r.fingerprint IS NOT NULL THEN 'project:' || fingerprint ELSE 'local:' || left(sha256('salt|' || url), 32) END AS project_id FROM f LEFT JOIN r USING (fingerprint)")
def s16_projects(spark, sf_dir):
    """Origins by fingerprint in a registry; what is not registered gets an id of its own path."""
    pages = table(spark, sf_dir, "pages")
    registry = pages.filter("page_id % 3 = 0").select(op.origin_fingerprint(F.col("url")).alias("fingerprint"), F.concat(F.lit("project:"), op.origin_fingerprint(F.col("url"))).alias("project"))
    return op.identify(pages.select("page_id", "url"), registry, "salt").select("page_id", "fingerprint", "identity_kind", "project_id")


_ENDPOINTS = {"page_id": "page_id", "url": "CASE page_id % 8 WHEN 0 THEN 'http://127.0.0.1:6333/v' || page_id || '//' WHEN 1 THEN 'http://localhost:8080' WHEN 2 THEN 'https://me:pw@localhost/x' WHEN 3 THEN 'http://localhost/x?a=1' WHEN 4 THEN 'ftp://localhost/' WHEN 5 THEN 'unix:/run/s' || page_id ELSE url END"}


@query("c12_destinations", with_(rec.cte("e", "pages", _ENDPOINTS), "c AS (SELECT page_id, CASE WHEN url LIKE 'unix:%' THEN url WHEN regexp_matches(url, '^https?://[^/?#@]+(/[^?#]*)?$') THEN regexp_replace(url, '/+$', '') END AS endpoint FROM e)") + "SELECT page_id, endpoint, CASE WHEN endpoint LIKE 'unix:%' OR regexp_matches(endpoint, '^https?://(127\\.0\\.0\\.1|localhost|\\[::1\\])(:[0-9]+)?(/|$)') THEN 'local:' || left(sha256('{\"dataUse\":\"memory\",\"endpoint\":\"' || endpoint || '\",\"nodeId\":\"node-1\",\"residency\":\"local\"}'), 32) END AS destination_id FROM c")
def c12_destinations(spark, sf_dir):
    """Canonical endpoints, and the ids of those that are local; credentials, queries and other schemes are refused."""
    e = rec.derived(spark, sf_dir, "pages", _ENDPOINTS)
    return e.select("page_id", op.canonical_endpoint(F.col("url")).alias("endpoint"), op.local_destination(F.col("url"), "node-1", "local", "memory").alias("destination_id"))


@query("c13_egress", with_(EPISODES) + "SELECT id, conv_id % 4 = 1 AND length(text) > 0 AS allowed FROM episodes")
def c13_egress(spark, sf_dir):
    """C13, C14, AD8: which texts may leave: an allowed destination by id, residency and data use together, and a final text."""
    from palimpsest.functions.secrets import may_egress

    to = F.struct(F.when(F.col("conv_id") % 4 == 1, "d1").otherwise("d2").alias("id"), F.when(F.col("conv_id") % 4 == 2, "us").otherwise("eu").alias("residency"), F.lit("memory").alias("data_use"))
    return rec.episodes(spark, sf_dir).select("id", may_egress(F.col("text"), to, [("d1", "eu", "memory"), ("d2", "eu", "other")]).alias("allowed"))


_WIRE = {"event_id": "event_id", "wire": "CASE event_id % 6 WHEN 0 THEN '{\"job_id\":' WHEN 1 THEN '[]' WHEN 2 THEN '{\"host\":\"alpha\",\"policy_id\":\"pol9\",\"policy_epoch\":1,\"prompt_revision\":\"r1\",\"items\":[\"a\"]}' ELSE '{\"host\":\"alpha\",\"policy_id\":\"pol' || (event_id % 4) || '\",\"policy_epoch\":' || (event_id % 2) || ',\"prompt_revision\":\"r1\",\"items\":[\"a\",\"b\"]}' END"}


@query("c15_envelopes", with_(rec.cte("w", "events", _WIRE)) + "SELECT event_id, CAST(CASE WHEN event_id % 6 < 2 THEN NULL WHEN event_id % 6 = 2 THEN 1 ELSE 2 END AS BIGINT) AS n_items, coalesce(CASE WHEN event_id % 6 > 1 THEN json_extract_string(wire, '$.policy_id') = 'pol' || (event_id % 4) AND json_extract_string(wire, '$.policy_epoch') = '1' AND json_extract_string(wire, '$.host') = 'alpha' AND json_extract_string(wire, '$.prompt_revision') = 'r1' END, false) AS matches FROM w")
def c15_envelopes(spark, sf_dir):
    """Proposal envelopes read strictly, and held against the job's host, policy, epoch and prompt."""
    rows = rec.derived(spark, sf_dir, "events", _WIRE).withColumn("e", op.envelope(F.col("wire")))
    expected = F.struct(F.lit("alpha").alias("host"), F.concat(F.lit("pol"), F.col("event_id") % 4).alias("policy_id"), F.lit(1).cast("long").alias("policy_epoch"), F.lit("r1").alias("prompt_revision"))
    return rows.select("event_id", F.when(F.col("e.items").isNotNull(), F.size("e.items")).cast("long").alias("n_items"), op.provenance_matches(F.col("e"), expected).alias("matches"))


@query("st2_delivery", with_(JOBS) + f"""
SELECT job_id, outcome, attempts + CASE WHEN outcome = 'retry' THEN 1 ELSE 0 END AS attempts, CASE WHEN outcome = 'retry' THEN {NOW} + CAST(greatest(1, least(30000, floor(least(30000, 500 * pow(2, least(30, attempts))) * (0.5 + CAST('0x' || left(sha256('{{"attempts":' || (attempts + 1) || ',"jobId":"' || job_id || '"}}'), 8) AS BIGINT) / 4294967295.0::DOUBLE * 0.5)))) AS BIGINT) END AS next_at
FROM (SELECT *, CASE WHEN lease_expires_at <= {NOW + SKEW_MS} THEN 'quarantined' WHEN created_at > {NOW} THEN 'pending' WHEN job_id % 5 = 1 THEN 'retry' WHEN job_id % 5 = 2 THEN 'quarantined' ELSE 'delivered' END AS outcome FROM jobs)""")
def st2_delivery(spark, sf_dir):
    """ST2, ST3, C11: one delivery pass: expired jobs and those that the processor refuses are quarantined, failures wait longer each time."""
    k = F.col("job_id")
    due = rec.jobs(spark, sf_dir).select("job_id", "attempts", F.col("lease_expires_at").alias("deadline"), F.col("created_at").alias("next_at"), F.when(k % 5 == 1, "failed").when(k % 5 == 2, "refused").otherwise("done").alias("result"))
    return op.deliver(due, NOW, SKEW_MS, 500, 30_000).select("job_id", "outcome", "attempts", F.when(F.col("outcome") == "retry", F.col("next_at")).alias("next_at"))


@query("p5_payload", with_(EPISODES) + "SELECT id, '{\"event_kind\":\"' || event_kind || '\",\"secret_scan\":\"passed\",\"session_id\":\"' || session_id || '\",\"status\":\"active\"}' AS payload, event_kind AS kind_read, true AS same FROM episodes")
def p5_payload(spark, sf_dir):
    """P5: records in wire form, and read back from it."""
    rows = rec.episodes(spark, sf_dir).select("id", F.col("event_kind").alias("eventKind"), F.col("session_id").alias("sessionId"))
    wire = op.to_payload(rows)
    back = op.from_payload(wire, "eventKind string, sessionId string, status string, secretScan string")
    return wire.join(back, "id").join(rows.withColumnRenamed("sessionId", "was").drop("eventKind"), "id").select("id", "payload", F.col("eventKind").alias("kind_read"), (F.col("sessionId") == F.col("was")).alias("same"))


@query("s17_hash_embedding", "SELECT item_id, round(v[1] / n, 6) AS a, round(v[2] / n, 6) AS b, round(v[3] / n, 6) AS c, round(v[4] / n, 6) AS d FROM (SELECT item_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT item_id, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT) / 2147483648.0::DOUBLE - 1.0) AS v FROM (SELECT item_id, sha256(text) AS h FROM benchmark)))")
def s17_hash_embedding(spark, sf_dir):
    """Deterministic stand-in embeddings, component by component."""
    v = table(spark, sf_dir, "benchmark").select("item_id", op.hash_embedding(F.col("text")).alias("v"))
    return v.select("item_id", *[F.round(F.element_at("v", i + 1), 6).alias(c) for i, c in enumerate("abcd")])


@query("s18_completions", with_(EPISODES) + "SELECT session_id, '{\"items\":[' || count(*) || ']}' AS completion, true AS valid FROM episodes GROUP BY session_id")
def s18_completions(spark, sf_dir):
    """An injected completer over prompts, bounded, and its output read strictly; here one that counts lines."""
    from palimpsest.functions import seams

    prompts = rec.episodes(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.collect_list(F.lit("line")), "\n").alias("prompt"))
    done = seams.complete(prompts, "prompt", lambda prompt: '{"items":[%d]}' % (prompt.count("\n") + 1))
    return done.select("session_id", "completion", (F.col("error").isNull() & seams.strict(F.col("completion"))).alias("valid"))
