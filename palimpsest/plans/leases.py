"""The lease machine: claims, renewals, releases, proposals, acceptance, coverage and completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import leases as op
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import BASE_MS, SKEW_MS, with_

NOW, LEASE_MS = BASE_MS, 60_000
CONTROL = op.Control("alpha")

_JOB = {
    "job_id": "o_orderkey", "owner_host": "CASE WHEN o_orderkey % 13 = 0 THEN 'beta' ELSE 'alpha' END", "policy_id": "'pol' || (o_custkey % 4)",
    "policy_epoch": "CASE WHEN o_orderkey % 17 = 3 THEN 0 ELSE 1 END", "privacy_epoch": "CASE WHEN o_orderkey % 19 = 5 THEN 0 ELSE 1 END",
    "deadline": f"CASE WHEN o_orderkey % 7 = 0 THEN {NOW} + (o_orderkey % 5 - 2) * 200000 END", "created_at": f"{NOW} - o_orderkey * 1000",
}
_LEASE = {
    "job_id": "o_orderkey", "owner_id": "'node' || (o_orderkey % 3)", "lease_policy_id": "CASE WHEN o_orderkey % 23 = 7 THEN 'pol9' ELSE 'pol' || (o_custkey % 4) END",
    "version": "o_orderkey % 4 + 1", "fencing_token": "o_orderkey % 5 + 1", "expires_at": f"{NOW} + (o_orderkey % 9 - 4) * 200000",
    "state": "CASE WHEN o_orderkey % 6 = 0 THEN 'completed' WHEN o_orderkey % 6 = 1 THEN 'accepted' WHEN o_orderkey % 6 = 2 THEN 'released' ELSE 'leased' END",
    "accepted_proposal_id": "CASE WHEN o_orderkey % 6 < 2 OR o_orderkey % 18 = 2 THEN 'prop-' || o_orderkey END",
}
_MEMBERS = "\nmembers AS (SELECT l_orderkey AS job_id, 'm-' || l_orderkey || '-' || l_linenumber AS id FROM lineitem GROUP BY ALL), held_members AS (SELECT job_id, string_agg(id, '\",\"' ORDER BY id) AS listed FROM members GROUP BY job_id)"
_CTES = (
    rec.cte("j0", "orders", _JOB), _MEMBERS, "\nj AS (SELECT j0.*, sha256('[\"' || listed || '\"]') AS manifest FROM j0 JOIN held_members USING (job_id))",
    rec.cte("l0", "orders", _LEASE), "\nl AS (SELECT *, CASE WHEN accepted_proposal_id IS NOT NULL THEN (SELECT manifest FROM j WHERE j.job_id = l0.job_id) END AS accepted_manifest_hash FROM l0 WHERE job_id % 4 <> 1)",
    "\nh AS (SELECT job_id, owner_id AS held_owner, version - CASE WHEN job_id % 10 = 4 THEN 1 ELSE 0 END AS held_version, fencing_token + CASE WHEN job_id % 14 = 6 THEN 1 ELSE 0 END AS held_fence FROM l)",
    "\nt AS (SELECT 'm-' || o_orderkey || '-1' AS target_id FROM orders WHERE o_orderkey % 16 = 11)",
)
_LIVE = f"(owner_host = 'alpha' AND policy_epoch = 1 AND privacy_epoch = 1 AND (deadline IS NULL OR deadline > {NOW + SKEW_MS}))"
_EXACT = f"(owner_id = held_owner AND version = held_version AND fencing_token = held_fence AND expires_at > {NOW})"
_UNTIL = f"least({NOW + LEASE_MS}, coalesce(deadline, {NOW + LEASE_MS}))"
_DEAD = "EXISTS (SELECT 1 FROM members m JOIN t ON t.target_id = m.id WHERE m.job_id = j.job_id)"


def members(spark, sf_dir):
    return rec.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("m-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id")).distinct()


def jobs(spark, sf_dir):
    listed = members(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return rec.derived(spark, sf_dir, "orders", _JOB).join(listed, "job_id")


def leases(spark, sf_dir, all_jobs):
    rows = rec.derived(spark, sf_dir, "orders", _LEASE).filter("job_id % 4 <> 1")
    manifest = all_jobs.select("job_id", op.members_hash(F.col("members")).alias("_manifest"))
    return rows.join(manifest, "job_id", "left").withColumn("accepted_manifest_hash", F.when(F.col("accepted_proposal_id").isNotNull(), F.col("_manifest"))).drop("_manifest")


def held(all_leases):
    k = F.col("job_id")
    return all_leases.select("job_id", F.col("owner_id").alias("held_owner"), (F.col("version") - F.when(k % 10 == 4, 1).otherwise(0)).alias("held_version"), (F.col("fencing_token") + F.when(k % 14 == 6, 1).otherwise(0)).alias("held_fence"))


def forgotten(spark, sf_dir):
    return rec.table(spark, sf_dir, "orders").filter("o_orderkey % 16 = 11").select(F.concat(F.lit("m-"), "o_orderkey", F.lit("-1")).alias("target_id"))


def _all(spark, sf_dir):
    j = jobs(spark, sf_dir)
    le = leases(spark, sf_dir, j)
    return j, le, held(le)


@query("st8_claims", with_(*_CTES) + f"""
SELECT job_id, outcome, CASE WHEN outcome IN ('refused', 'held') THEN owner_id ELSE claimant END AS owner_id, CAST(CASE WHEN outcome IN ('refused', 'held') THEN version ELSE coalesce(version + 1, 1) END AS BIGINT) AS version,
  CAST(CASE WHEN outcome IN ('refused', 'held') THEN fencing_token ELSE coalesce(fencing_token + 1, 1) END AS BIGINT) AS fencing_token, CASE WHEN outcome IN ('refused', 'held') THEN expires_at ELSE {_UNTIL} END AS expires_at,
  CASE WHEN outcome IN ('refused', 'held') THEN state WHEN state = 'accepted' OR (state = 'released' AND accepted_proposal_id IS NOT NULL) THEN 'accepted' WHEN state IS NULL OR state = 'released' THEN 'leased' ELSE state END AS state
FROM (SELECT *, CASE WHEN NOT {_LIVE} THEN 'refused' WHEN version IS NULL THEN 'fresh' WHEN state = 'completed' OR lease_policy_id <> policy_id THEN 'refused'
    WHEN owner_id = claimant AND state <> 'released' AND expires_at > {NOW} THEN CASE WHEN deadline IS NULL OR expires_at <= deadline THEN 'held' ELSE 'refused' END
    WHEN owner_id = claimant AND state <> 'released' THEN CASE WHEN expires_at + {SKEW_MS} <= {NOW} THEN 'refreshed' ELSE 'refused' END
    WHEN state = 'released' OR expires_at + {SKEW_MS} <= {NOW} THEN 'stolen' ELSE 'refused' END AS outcome
  FROM (SELECT j.*, 'node' || (j.job_id % 2) AS claimant, l.* EXCLUDE (job_id) FROM j LEFT JOIN l USING (job_id)))""")
def st8_claims(spark, sf_dir):
    """ST8: first claims, own live and lapsed leases, thefts and refusals, with fence and version."""
    j, le, _ = _all(spark, sf_dir)
    asked = j.select("job_id", F.concat(F.lit("node"), F.col("job_id") % 2).alias("claimant"))
    return op.claim(j, le, asked, CONTROL, NOW, SKEW_MS, LEASE_MS).select("job_id", "outcome", "owner_id", "version", "fencing_token", "expires_at", "state")


@query("st8_renewals", with_(*_CTES) + f"SELECT job_id, ok AS renewed, CASE WHEN ok THEN version + 1 ELSE version END AS version, CASE WHEN ok THEN {_UNTIL} ELSE expires_at END AS expires_at, fencing_token FROM (SELECT *, {_LIVE} AND {_EXACT} AS ok FROM h JOIN j USING (job_id) JOIN l USING (job_id))")
def st8_renewals(spark, sf_dir):
    """ST8: leases after their holders renew them; stale and lapsed authorities are refused."""
    out = op.renew(*_all(spark, sf_dir), CONTROL, NOW, SKEW_MS, LEASE_MS)
    return out.select("job_id", (F.col("outcome") == "renewed").alias("renewed"), "version", "expires_at", "fencing_token")


@query("st8_releases", with_(*_CTES) + f"SELECT job_id, CASE WHEN ok THEN version + 1 ELSE version END AS version, CASE WHEN ok THEN 'released' ELSE state END AS state FROM (SELECT *, {_LIVE} AND {_EXACT} AS ok FROM h JOIN j USING (job_id) JOIN l USING (job_id))")
def st8_releases(spark, sf_dir):
    """ST8: leases after their holders give them up while the control drains."""
    return op.release(*_all(spark, sf_dir), op.Control("alpha", "draining"), NOW, SKEW_MS).select("job_id", "version", "state")


_FITS = "(deadline IS NULL OR expires_at <= deadline)"
_UUID = "left({d}, 8) || '-' || substr({d}, 9, 4) || '-5' || substr({d}, 14, 3) || '-' || lower(printf('%02x', (CAST('0x' || substr({d}, 17, 2) AS INT) & 63) | 128)) || substr({d}, 19, 2) || '-' || substr({d}, 21, 12)"


def _contents(j):
    """What holders propose: some about members that are not the job's."""
    proposed = F.when(F.col("job_id") % 12 == 3, F.slice("members", 1, 1)).otherwise(F.col("members"))
    return j.select("job_id", proposed.alias("proposed"), F.concat(F.lit('{"items":['), F.col("job_id"), F.lit("]}")).alias("content"))


@query("c2_proposals", with_(*_CTES) + f"""
SELECT job_id, outcome, proposal_hash, manifest AS manifest_hash, {_UUID.format(d="d")} AS proposal_id FROM (SELECT *, sha256('proposal|' || job_id || '|' || proposal_hash) AS d FROM (
  SELECT j.job_id, manifest, CASE WHEN {_LIVE} AND {_EXACT} AND state = 'leased' AND lease_policy_id = policy_id AND {_FITS} AND (j.job_id % 12 <> 3 OR (SELECT count(*) FROM members m WHERE m.job_id = j.job_id) = 1) AND NOT {_DEAD} THEN 'written' ELSE 'refused' END AS outcome,
    sha256(concat_ws('|', '{{"items":[' || j.job_id || ']}}', j.job_id, owner_host, owner_id, manifest, policy_id, policy_epoch, privacy_epoch, fencing_token)) AS proposal_hash
  FROM h JOIN j USING (job_id) JOIN l USING (job_id)))""")
def c2_proposals(spark, sf_dir):
    """Proposals that live holders may write about exactly their jobs' members, with ids by content."""
    j, le, h = _all(spark, sf_dir)
    return op.write_proposals(j, le, h, _contents(j), forgotten(spark, sf_dir), CONTROL, NOW, SKEW_MS).select("job_id", "outcome", "proposal_hash", "manifest_hash", "proposal_id")


@query("c3_acceptance", with_(*_CTES) + f"""
SELECT job_id, CASE WHEN ok THEN 'accepted' ELSE 'refused' END AS outcome, CASE WHEN ok THEN version + 1 ELSE version END AS version, CASE WHEN ok THEN 'accepted' ELSE state END AS state, CASE WHEN ok THEN proposal_id ELSE accepted_proposal_id END AS accepted_proposal_id
FROM (SELECT j.*, l.* EXCLUDE (job_id), p.proposal_id, coalesce({_LIVE} AND {_EXACT} AND state = 'leased' AND lease_policy_id = policy_id AND p.proposal_id IS NOT NULL AND NOT {_DEAD}, false) AS ok
  FROM h JOIN j USING (job_id) JOIN l USING (job_id) LEFT JOIN (SELECT job_id, 'a-' || job_id AS proposal_id FROM l WHERE job_id % 5 <> 2) p USING (job_id))""")
def c3_acceptance(spark, sf_dir):
    """One proposal of each job is accepted: by its present holder, under the present fence, about its members."""
    j, le, h = _all(spark, sf_dir)
    manifest = j.select("job_id", op.members_hash(F.col("members")).alias("manifest_hash"))
    own = le.filter("job_id % 5 <> 2").join(manifest, "job_id").select("job_id", F.concat(F.lit("a-"), "job_id").alias("proposal_id"), "manifest_hash", F.col("owner_id").alias("proposal_owner"), F.col("fencing_token").alias("proposal_fence"))
    # a later one of the same holder, and one under an old fence
    more = own.withColumn("proposal_id", F.concat(F.lit("b-"), "job_id")).unionByName(own.withColumns({"proposal_id": F.concat(F.lit("0-"), "job_id"), "proposal_fence": F.col("proposal_fence") - 1}))
    return op.accept(j, le, h, own.unionByName(more), forgotten(spark, sf_dir), CONTROL, NOW, SKEW_MS).select("job_id", "outcome", "version", "state", "accepted_proposal_id")


@query("c5_coverage", with_(*_CTES) + f"""
SELECT {_UUID.format(d="d")} AS id, job_id, episode_id, created_at FROM (
  SELECT j.job_id, m.id AS episode_id, CASE WHEN j.job_id % 3 = 0 THEN j.created_at ELSE {NOW} + j.job_id END AS created_at, sha256(concat_ws('|', 'coverage', owner_host, m.id, 'x1', policy_id, policy_epoch, privacy_epoch)) AS d
  FROM j JOIN l USING (job_id) JOIN members m ON m.job_id = j.job_id WHERE state = 'accepted' AND expires_at > {NOW}) WHERE job_id % 5 <> 0""")
def c5_coverage(spark, sf_dir):
    """Coverage rows to append for accepted jobs; what is stored already is not written again."""
    j, le, _ = _all(spark, sf_dir)
    episodes = members(spark, sf_dir).filter("job_id % 3 <> 0").select("id", (F.lit(NOW) + F.col("job_id")).alias("created_at"))
    stored = op.mark_coverage(j.filter("job_id % 5 = 0"), le, episodes, spark.createDataFrame([], "id string"), "x1", NOW)
    return op.mark_coverage(j, le, episodes, stored, "x1", NOW)


@query("c4_completeness", with_(*_CTES) + f"""
SELECT job_id, CASE WHEN ok THEN 'completed' ELSE 'refused' END AS outcome, CASE WHEN ok THEN 'completed' ELSE state END AS state, CASE WHEN ok THEN version + 1 ELSE version END AS version
FROM (SELECT j.*, l.* EXCLUDE (job_id), {_LIVE} AND {_EXACT} AND state = 'accepted' AND j.job_id % 8 <> 5 AND j.job_id % 9 <> 4 AS ok FROM h JOIN j USING (job_id) JOIN l USING (job_id))""")
def c4_completeness(spark, sf_dir):
    """C4: acceptance becomes completion where nothing that was to be written is missing."""
    j, le, h = _all(spark, sf_dir)
    covered = members(spark, sf_dir).filter("job_id % 8 <> 5").select(F.col("id").alias("episode_id"))
    expected = j.select("job_id", F.concat(F.lit("obs-"), "job_id").alias("id"))
    written = expected.filter("job_id % 9 <> 4").select("id")
    return op.complete(j, le, h, covered, expected, written, CONTROL, NOW, SKEW_MS).select("job_id", "outcome", "state", "version")


@query("j8_acceptance", with_(*_CTES) + "SELECT j.job_id FROM j JOIN l USING (job_id) WHERE l.state = 'accepted' AND l.lease_policy_id = j.policy_id AND l.accepted_proposal_id = 'prop-' || j.job_id AND l.accepted_manifest_hash = j.manifest AND (j.deadline IS NULL OR l.expires_at <= j.deadline) AND j.job_id % 11 <> 1")
def j8_acceptance(spark, sf_dir):
    """Accepted jobs whose lease, proposal and membership agree in every field."""
    j, le, _ = _all(spark, sf_dir)
    proposals = j.select("job_id", F.concat(F.lit("prop-"), "job_id").alias("accepted_proposal_id"), op.members_hash(F.col("members")).alias("accepted_manifest_hash"), F.when(F.col("job_id") % 11 == 1, "pol9").otherwise(F.col("policy_id")).alias("proposal_policy"))
    same = (F.col("lease_policy_id") == F.col("policy_id")) & (F.col("proposal_policy") == F.col("policy_id")) & (F.col("deadline").isNull() | (F.col("expires_at") <= F.col("deadline")))
    return j.drop("created_at").join(le.filter("state = 'accepted'"), "job_id").join(proposals, ["job_id", "accepted_proposal_id", "accepted_manifest_hash"]).filter(same).select("job_id")
