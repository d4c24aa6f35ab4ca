"""Jobs, leases, proposals and coverage: a fenced state machine over tables of rows.

Each transition takes the rows as they were read and returns them as a conditional write
leaves them, with an ``outcome``: a row whose expected state does not hold stays as it is.
Times are milliseconds. A lease is surely lapsed, so that another may take it, only when
its expiry and the clock skew have passed; its owner may act only before its expiry.

A job has job_id, owner_host, policy_id, policy_epoch, privacy_epoch, members (sorted),
deadline (or null) and created_at; a lease job_id, owner_id, lease_policy_id, version,
fencing_token, expires_at, state, accepted_proposal_id and accepted_manifest_hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import uuid_from_digest

LEASE = ["owner_id", "lease_policy_id", "version", "fencing_token", "expires_at", "state", "accepted_proposal_id", "accepted_manifest_hash"]
MAX_MEMBERS = 65_536


@dataclass(frozen=True)
class Control:
    """The collection's control row as it was read."""

    owner_host: str
    state: str = "active"
    policy_epoch: int = 1
    privacy_epoch: int = 1


def members_hash(members: Column) -> Column:
    """The manifest hash of an ordered membership."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(members, '","'), F.lit('"]')), 256)


def _live_job(control: Control, now: int, skew: int, states: tuple[str, ...] = ("active",)) -> Column:
    """Whether the row's job is under the control as read, and its deadline not reached."""
    known = (F.col("owner_host") == control.owner_host) & (F.col("policy_epoch") == control.policy_epoch) & (F.col("privacy_epoch") == control.privacy_epoch)
    return F.lit(control.state in states) & known & (F.col("deadline").isNull() | (F.col("deadline") > now + skew))


def _until(now: int, lease_ms: int) -> Column:
    """A lease never outlives its job."""
    return F.least(F.lit(now + lease_ms), F.coalesce("deadline", F.lit(now + lease_ms)))


def _moved(rows: DataFrame, outcome: Column, **changes: Column) -> DataFrame:
    """Rows with their outcome, and the changes where it is not refused or held."""
    judged = rows.withColumn("outcome", outcome)
    won = ~F.col("outcome").isin("refused", "held")
    return judged.withColumns({name: F.when(won, value).otherwise(F.col(name)) for name, value in changes.items()})


def claim(jobs: DataFrame, leases: DataFrame, requests: DataFrame, control: Control, now: int, skew: int, lease_ms: int) -> DataFrame:
    """What becomes of each request (job_id, claimant) to work on a job, with the lease after it.

    fresh: the first lease. held: the claimant's own live one, unchanged. refreshed: its
    own lapsed one, with a new fence. stolen: another's surely lapsed or a released one,
    with a new fence; an acceptance stays. Everything else is refused.
    """
    rows = requests.join(jobs, "job_id", "left").join(leases, "job_id", "left")
    none, lapsed = F.col("version").isNull(), F.col("expires_at") + skew <= now
    own = (F.col("owner_id") == F.col("claimant")) & (F.col("state") != "released")
    fits = F.col("deadline").isNull() | (F.col("expires_at") <= F.col("deadline"))
    outcome = (
        F.when(~F.coalesce(_live_job(control, now, skew), F.lit(False)), "refused")
        .when(none, "fresh")
        .when((F.col("state") == "completed") | (F.col("lease_policy_id") != F.col("policy_id")), "refused")
        .when(own & (F.col("expires_at") > now), F.when(fits, "held").otherwise("refused"))
        .when(own, F.when(lapsed, "refreshed").otherwise("refused"))
        .when((F.col("state") == "released") | lapsed, "stolen")
        .otherwise("refused")
    )
    up = lambda c: F.coalesce(F.col(c) + 1, F.lit(1)).cast("long")
    accepted = (F.col("state") == "accepted") | ((F.col("state") == "released") & F.col("accepted_proposal_id").isNotNull())
    return _moved(
        rows, outcome, owner_id=F.col("claimant"), lease_policy_id=F.col("policy_id"), version=up("version"), fencing_token=up("fencing_token"), expires_at=_until(now, lease_ms),
        state=F.when(accepted, "accepted").when(F.col("state").isNull() | (F.col("state") == "released"), "leased").otherwise(F.col("state")),
    )


def _exact(now: int) -> Column:
    """Whether the row's authority is the lease as it is now, and alive: owner, version and fence."""
    same = (F.col("owner_id") == F.col("held_owner")) & (F.col("version") == F.col("held_version")) & (F.col("fencing_token") == F.col("held_fence"))
    return F.coalesce(same & (F.col("expires_at") > now), F.lit(False))


def renew(jobs: DataFrame, leases: DataFrame, held: DataFrame, control: Control, now: int, skew: int, lease_ms: int) -> DataFrame:
    """Leases after their holders (job_id, held_owner, held_version, held_fence) renew them; the fence stays."""
    rows = held.join(jobs, "job_id").join(leases, "job_id")
    ok = F.coalesce(_live_job(control, now, skew), F.lit(False)) & _exact(now)
    return _moved(rows, F.when(ok, "renewed").otherwise("refused"), version=F.col("version") + 1, expires_at=_until(now, lease_ms))


def release(jobs: DataFrame, leases: DataFrame, held: DataFrame, control: Control, now: int, skew: int) -> DataFrame:
    """Leases after their holders give them up, which a draining control allows too."""
    rows = held.join(jobs, "job_id").join(leases, "job_id")
    ok = F.coalesce(_live_job(control, now, skew, ("active", "draining")), F.lit(False)) & _exact(now)
    return _moved(rows, F.when(ok, "released").otherwise("refused"), version=F.col("version") + 1, state=F.lit("released"))


def write_proposals(jobs: DataFrame, leases: DataFrame, held: DataFrame, proposals: DataFrame, tombstones: DataFrame, control: Control, now: int, skew: int) -> DataFrame:
    """Proposals (job_id, proposed, content) that may be written, with their ids; others are refused.

    The holder's lease must be exact, alive and not yet accepted, the proposed members
    must be the job's, and none may be forgotten. The hash binds content, job, owner,
    members, policy, epochs and fence, so that equal work converges on one row.
    """
    rows = held.join(jobs, "job_id").join(leases, "job_id").join(proposals, "job_id")
    dead = rows.select("job_id", F.explode("members").alias("target_id")).join(tombstones.select("target_id").distinct(), "target_id", "left_semi").select("job_id").distinct()
    marked = rows.join(dead.withColumn("_dead", F.lit(True)), "job_id", "left")
    fits = F.col("deadline").isNull() | (F.col("expires_at") <= F.col("deadline"))
    ok = F.coalesce(_live_job(control, now, skew) & (F.col("state") == "leased") & (F.col("lease_policy_id") == F.col("policy_id")) & fits & (F.col("proposed") == F.col("members")), F.lit(False)) & _exact(now) & F.col("_dead").isNull()
    body = F.concat_ws("|", "content", "job_id", "owner_host", "owner_id", members_hash(F.col("members")), "policy_id", F.col("policy_epoch").cast("string"), F.col("privacy_epoch").cast("string"), F.col("fencing_token").cast("string"))
    hashed = marked.withColumns({"outcome": F.when(ok, "written").otherwise("refused"), "proposal_hash": F.sha2(body, 256), "manifest_hash": members_hash(F.col("members"))})
    return hashed.withColumn("proposal_id", uuid_from_digest(F.sha2(F.concat_ws("|", F.lit("proposal"), "job_id", "proposal_hash"), 256))).drop("_dead", "proposed")


def accept(jobs: DataFrame, leases: DataFrame, held: DataFrame, proposals: DataFrame, tombstones: DataFrame, control: Control, now: int, skew: int) -> DataFrame:
    """Leases after one proposal of each is accepted: leased becomes accepted, bound to it.

    ``proposals`` are written rows: job_id, proposal_id, manifest_hash, proposal_owner and
    proposal_fence. A job accepts once, and only what its present holder wrote under the
    present fence about exactly its members; of several, that with the smallest id.
    """
    rows = held.join(jobs, "job_id").join(leases, "job_id")
    own = proposals.join(rows.select("job_id", F.col("owner_id").alias("proposal_owner"), F.col("fencing_token").alias("proposal_fence")), ["job_id", "proposal_owner", "proposal_fence"], "left_semi")
    one = own.groupBy("job_id").agg(F.min(F.struct("proposal_id", "manifest_hash")).alias("p")).select("job_id", "p.*")
    rows = rows.join(one, "job_id", "left")
    dead = rows.select("job_id", F.explode("members").alias("target_id")).join(tombstones.select("target_id").distinct(), "target_id", "left_semi").select("job_id").distinct()
    marked = rows.join(dead.withColumn("_dead", F.lit(True)), "job_id", "left")
    bound = F.col("manifest_hash") == members_hash(F.col("members"))
    ok = F.coalesce(_live_job(control, now, skew) & (F.col("state") == "leased") & (F.col("lease_policy_id") == F.col("policy_id")) & bound, F.lit(False)) & _exact(now) & F.col("_dead").isNull()
    return _moved(marked, F.when(ok, "accepted").otherwise("refused"), version=F.col("version") + 1, state=F.lit("accepted"), accepted_proposal_id=F.col("proposal_id"), accepted_manifest_hash=F.col("manifest_hash")).drop("_dead")


def coverage_id() -> Column:
    """The id of a coverage row: it binds episode, extractor, policy and both epochs."""
    return uuid_from_digest(F.sha2(F.concat_ws("|", F.lit("coverage"), "owner_host", "episode_id", "extractor", "policy_id", F.col("policy_epoch").cast("string"), F.col("privacy_epoch").cast("string")), 256))


def mark_coverage(jobs: DataFrame, leases: DataFrame, episodes: DataFrame, stored: DataFrame, extractor: str, now: int) -> DataFrame:
    """Coverage rows to append: every member of each accepted, live job that has none yet.

    A row is dated by its episode, or by its job where the episode is gone; one that is
    there already is not written twice.
    """
    live = leases.filter((F.col("state") == "accepted") & (F.col("expires_at") > now)).select("job_id")
    members = jobs.join(live, "job_id", "left_semi").select("job_id", "owner_host", "policy_id", "policy_epoch", "privacy_epoch", F.col("created_at").alias("job_at"), F.explode("members").alias("episode_id"))
    dated = members.join(episodes.select(F.col("id").alias("episode_id"), F.col("created_at").alias("episode_at")), "episode_id", "left")
    rows = dated.withColumns({"extractor": F.lit(extractor), "created_at": F.coalesce("episode_at", "job_at")}).withColumn("id", coverage_id())
    once = rows.groupBy("id").agg(F.min(F.struct("job_id", "episode_id", "created_at")).alias("r")).select("id", "r.*")
    return once.join(stored.select("id"), "id", "left_anti")


def complete(jobs: DataFrame, leases: DataFrame, held: DataFrame, coverage: DataFrame, expected: DataFrame, written: DataFrame, control: Control, now: int, skew: int) -> DataFrame:
    """Leases after their holders prove that all is written: accepted becomes completed.

    Every member needs coverage (episode_id), and every ``expected`` row (job_id, id),
    such as an observation or a link, must be among the ``written`` ids. The proof is of
    the sets, by what is missing, not of counts. The manifest must be the job's.
    """
    rows = held.join(jobs, "job_id").join(leases, "job_id")
    uncovered = rows.select("job_id", F.explode("members").alias("episode_id")).join(coverage.select("episode_id").distinct(), "episode_id", "left_anti").select("job_id")
    unwritten = expected.join(written.select("id").distinct(), "id", "left_anti").select("job_id")
    lacking = uncovered.unionByName(unwritten).distinct().withColumn("_lacks", F.lit(True))
    ok = F.coalesce(_live_job(control, now, skew) & (F.col("state") == "accepted") & (F.col("accepted_manifest_hash") == members_hash(F.col("members"))), F.lit(False)) & _exact(now) & F.col("_lacks").isNull()
    return _moved(rows.join(lacking, "job_id", "left"), F.when(ok, "completed").otherwise("refused"), version=F.col("version") + 1, state=F.lit("completed")).drop("_lacks")
