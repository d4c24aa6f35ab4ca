"""Jobs, leases, coverage, tombstones, policies and sinks over versioned tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.identity import logical_id
from palimpsest.sources.shared import written


def classify_insert(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """insert, existing or collision for each arriving (id, content_hash): equal ids must have equal hashes."""
    known = stored.select("id", F.col("content_hash").alias("stored_hash"))
    how = F.when(F.col("stored_hash").isNull(), "insert").when(F.col("stored_hash") == F.col("content_hash"), "existing").otherwise("collision")
    return arriving.join(known, "id", "left").select("id", "content_hash", how.alias("outcome"))


def insert_only(arriving: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to append; a collision fails the write."""
    refused = F.raise_error(F.lit("an id is stored with other content")).cast("string")
    checked = F.when(F.col("outcome") == "collision", refused).otherwise(F.col("outcome"))
    return classify_insert(arriving, stored).filter(checked == "insert").select("id", "content_hash")


def latest_version(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The state that compare-and-set leaves: the largest version of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, *[f"r.{c}" for c in rest])


def compare_and_set(stored: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """Stored rows after conditional writes: a proposal (key, expected, and the new values) applies where its
    expected version is the stored one.

    Returns the columns of ``stored`` and ``outcome``: applied, stale or untouched. Of several that
    expect the same version the first by its new values applies, and the others are stale.
    """
    values = [c for c in stored.columns if c not in (key, "version")]
    best = proposed.groupBy(key, F.col("expected").alias("version")).agg(F.min(F.struct(*values)).alias("_new"))
    asked = proposed.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = stored.join(best, [key, "version"], "left").join(asked, key, "left")
    hit = F.col("_new").isNotNull()
    outcome = F.when(hit, "applied").when(F.col("_asked"), "stale").otherwise("untouched")
    moved = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values}
    return joined.withColumns({"outcome": outcome, **moved, "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))}).select(*stored.columns, "outcome")


def claimable(now: int, skew: int) -> Column:
    """Whether a lease may be claimed: released, or surely lapsed; never once completed or accepted."""
    return (F.col("state") == "released") | ((F.col("state") == "leased") & (F.col("lease_expires_at") + skew <= now))


def retry_delay(key: Column, attempts: Column, base: int, most: int) -> Column:
    """Exponential delay with a jitter that the key and the attempt fix."""
    bounded = F.least(F.lit(most), base * F.pow(F.lit(2), F.least(F.lit(30), F.greatest(F.lit(0), attempts - 1))))
    digest = F.sha2(F.concat(F.lit('{"attempts":'), attempts, F.lit(',"jobId":"'), key, F.lit('"}')), 256)
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 0xFFFFFFFF
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(bounded * (0.5 + share * 0.5)))).cast("long")


def uncovered(episodes: DataFrame, coverage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Episodes that no coverage row of the same keys marks."""
    return episodes.join(coverage, list(keys), "left_anti")


def forgotten(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Records that any of their targets hides: own id, evidence, content, observation or state."""
    targets = F.array_compact(F.array_distinct(F.concat(F.array("id", "content_id", "state_key"), F.coalesce("evidence_ids", F.array().cast("array<string>")))))
    hit = records.select("id", F.explode(targets).alias("target_id")).join(tombstones.select("target_id").distinct(), "target_id", "left_semi")
    return records.join(hit.select("id").distinct(), "id", "left_semi")


def visible(records: DataFrame, tombstones: DataFrame) -> DataFrame:
    return records.join(forgotten(records, tombstones).select("id"), "id", "left_anti")


ANY_ORIGIN = "any"
DESTINATIONS = ("store_id", "embedding_id", "llm_id")


def intersect_policies(members: DataFrame, group: str, worker: dict | None = None) -> DataFrame:
    """The policy that all policies of a group allow, or incompatible where they disagree.

    Owner, residency, data use and every destination must be equal, and a destination that
    one names all must name. The earliest expiry holds, and replay only if all allow it.
    A ``worker`` (a dict of the same fields) joins each group: its origin may be "any";
    otherwise the members need one origin, and another one than the worker's only where
    it and all of them allow replay. The revision is a hash of the distinct members (and
    the worker), so equal groups agree.
    """
    fields = ["owner_host", "residency", "data_use", *DESTINATIONS]
    absent = "\x00"
    one = F.lit(True)
    for c in fields:
        one &= (F.col(f"lo_{c}") == F.col(f"hi_{c}")) & (F.lit(True) if worker is None else F.col(f"lo_{c}") == F.lit(worker.get(c) or absent))
    origins = F.col("lo_origin") == F.col("hi_origin")
    if worker is not None:
        crossed = F.lit(bool(worker["allow_replay"])) & F.col("allow_replay")
        origins = F.lit(worker["origin"] == ANY_ORIGIN) | (origins & ((F.col("lo_origin") == worker["origin"]) | crossed))
    filled = lambda c: F.coalesce(c, F.lit(absent))
    sums = members.groupBy(group).agg(
        *[f(filled(c)).alias(f"{side}_{c}") for c in (*fields, "origin") for side, f in (("lo", F.min), ("hi", F.max))],
        F.bool_and("allow_replay").alias("allow_replay"),
        F.min("expires_at").alias("expires_at"),
        F.array_join(F.array_sort(F.collect_set("policy_id")), ",").alias("_ids"),
    )
    identity = F.col("_ids") if worker is None else F.concat("_ids", F.lit(f"|{worker['policy_id']}"))
    judged = sums.withColumns({"compatible": one & origins, "revision": F.sha2(identity, 256)})
    if worker is not None:
        judged = judged.withColumns({"allow_replay": F.col("allow_replay") & F.lit(bool(worker["allow_replay"])), "expires_at": F.least("expires_at", F.lit(worker.get("expires_at")).cast("long"))})
    shown = lambda c: F.when(F.col("compatible") & (F.col(f"lo_{c}") != absent), F.col(f"lo_{c}")).alias(c)
    out = lambda c: F.when(F.col("compatible"), F.col(c)).alias(c)
    return judged.select(group, "compatible", shown("residency"), shown("store_id"), shown("llm_id"), out("allow_replay"), out("expires_at"), out("revision"))


def group_by_policy(episodes: DataFrame, policies: DataFrame, worker: dict) -> tuple[DataFrame, DataFrame]:
    """(groups, pending): episodes by the intersection of their own policy with the worker's.

    Groups have policy_id, position (by policy id), n and the intersection; the ids of
    episodes whose policy is missing, incompatible or names no language model are pending.
    """
    each = intersect_policies(policies.withColumn("processing_policy_id", F.col("policy_id")), "processing_policy_id", worker)
    usable = each.filter(F.col("compatible") & F.col("llm_id").isNotNull())
    held = episodes.groupBy("processing_policy_id").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as policies
    groups = held.join(usable, "processing_policy_id").withColumn("position", F.row_number().over(Window.orderBy("processing_policy_id")).cast("long"))
    pending = episodes.join(usable, "processing_policy_id", "left_anti").select("id")
    return groups, pending


def resume_job(jobs: DataFrame) -> DataFrame:
    """(producer_id, job_id, rank, terminal): the job that each producer takes up next, or why there is none.

    Needs producer_id, job_id, state (null for a plan without a job yet), created_at and
    tombstoned. Accepted work comes first, then durable work that was leased or released,
    then plans, and last an acceptance that a tombstone blocks; within these by age and
    id. Where nothing is left the reason is tombstoned-durable-job, all-tombstoned or
    already-covered.
    """
    clean, state = ~F.col("tombstoned"), F.col("state")
    rank = F.when((state == "accepted") & clean, 1).when(state.isin("leased", "released") & clean, 2).when(state.isNull() & clean, 3).when(state == "accepted", 4)
    ranked = jobs.withColumn("rank", rank)
    best = ranked.groupBy("producer_id").agg(
        F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "created_at", "job_id"))).alias("b"),
        F.bool_or(F.coalesce(state.isin("leased", "released"), F.lit(False))).alias("durable"),
        F.bool_and("tombstoned").alias("dead"),
    )
    why = F.when(F.col("durable"), "tombstoned-durable-job").when(F.col("dead"), "all-tombstoned").otherwise("already-covered")
    return best.select("producer_id", "b.job_id", "b.rank", F.when(F.col("b").isNull(), why).alias("terminal"))


def outbox_jobs(episodes: DataFrame, size: int = 1024) -> DataFrame:
    """Deterministic jobs of at most ``size`` episodes of a session, in id order.

    Returns session_id, chunk, size, created_at (the latest member's), bytes of text,
    job_id and an audit hash over all of it. Numbering moves ids only.
    """
    placed = episodes.select("session_id", "id", "created_at", F.octet_length("text").alias("b")).withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("id")) - 1) / size).cast("long"))
    jobs = placed.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("size"), F.max("created_at").alias("created_at"), F.sum("b").cast("long").alias("bytes"), F.array_join(F.array_sort(F.collect_list("id")), "|").alias("_members"))
    named = jobs.withColumn("job_id", logical_id("job", F.col("session_id"), F.col("_members"))).drop("_members")
    return named.withColumn("audit_hash", audit_hash())


def audit_hash() -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("job_id", "session_id", "chunk", "size", "created_at", "bytes")]), 256)


def trigger(turns: Column, calls: Column, pending: Column, most_turns: int = 10, most_calls: int = 15) -> Column:
    """Whether curation runs now."""
    return F.when(pending <= 0, "idle").when((turns >= most_turns) | (calls >= most_calls), "run").otherwise("wait")


def _fold(rows: DataFrame, group: str, order: Sequence[str], columns: Sequence[str], schema: str, start: Callable[[], dict], step: Callable[[dict, tuple], tuple | None]) -> DataFrame:
    """A sequential fold over the rows of each group in order, which streams: a task holds one state.

    ``step`` may change the state and returns what the row gives, without its group, or None.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start()
        for batch in batches:
            out = []
            for key, *values in batch[[group, *columns]].itertuples(index=False):
                if now is None or key != now:
                    now, state = key, start()
                if (given := step(state, tuple(values))) is not None:
                    out.append((key, *given))
            yield pd.DataFrame(out, columns=names)

    sorted_ = rows.select(group, *dict.fromkeys([*order, *columns])).repartition(group).sortWithinPartitions(group, *order)
    return sorted_.mapInPandas(run, schema)


def greedy_pack(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Parts of consecutive rows within a budget; a row at or over it closes its part.

    A running total that starts again is no window function: it is a sequential fold over
    each group in order.
    """

    def step(state: dict, row: tuple) -> tuple:
        item, weight = row
        if state["used"] and state["used"] + weight > budget:
            state.update(part=state["part"] + 1, used=0)
        part = state["part"]
        state["used"] += weight
        if weight >= budget:
            state.update(part=part + 1, used=0)
        return item, part

    return _fold(rows, group, [order], [order, size], f"{group} string, {order} string, part long", lambda: {"part": 0, "used": 0}, step)


def admit(reservations: DataFrame, group: str, order: str, size: str, max_jobs: int, max_bytes: int) -> DataFrame:
    """Which reservations are admitted, in id order, under a cap of jobs and one of bytes.

    A reservation that does not fit is passed over, and a later, smaller one may still be
    admitted. Returns group, order and admitted.
    """

    def step(state: dict, row: tuple) -> tuple:
        item, weight = row
        fits = state["jobs"] + 1 <= max_jobs and state["bytes"] + weight <= max_bytes
        if fits:
            state.update(jobs=state["jobs"] + 1, bytes=state["bytes"] + weight)
        return item, fits

    return _fold(reservations, group, [order], [order, size], f"{group} string, {order} long, admitted boolean", lambda: {"jobs": 0, "bytes": 0}, step)


def fair_order(jobs: DataFrame, producer: str, job: str, cursor: int, budget: int) -> tuple[DataFrame, int]:
    """(selected, next cursor): the next ``budget`` jobs in a cycle through all, from the cursor on.

    Jobs are in order of producer and id. A job's place is its place within its producer
    after the jobs of the producers before, so no task orders them all.
    """
    sizes = jobs.groupBy(producer).agg(F.count(F.lit(1)).alias("n"))
    # a row for each producer
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy(producer).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(producer, "_before")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not total:
        return jobs.select(producer, job).withColumn("turn", F.lit(0).cast("long")).limit(0), 0
    start, taken = cursor % total, min(budget, total)
    placed = jobs.select(producer, job).join(before, producer).withColumn("_place", F.col("_before") + F.row_number().over(Window.partitionBy(producer).orderBy(job)) - 1)
    turned = placed.withColumn("turn", F.pmod(F.col("_place") - start, F.lit(total)).cast("long")).filter(F.col("turn") < taken)
    return turned.select(producer, job, "turn"), (start + taken) % total


def descend(roots: DataFrame, edges: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """Every node below the roots, with the best score and the least depth that reach it.

    A driver loop over at most ``depth`` levels, which ends at the first empty one. A
    level is written to the shared folder and holds only nodes that no level before
    had, so no chain is followed twice. More than ``most`` nodes fail the descent.
    """
    keep = lambda df: written(df, "level")
    level = keep(roots.select("id", "score").groupBy("id").agg(F.max("score").alias("score")))
    found = level.withColumn("depth", F.lit(0))
    for n in range(1, depth + 1):
        below = level.join(edges.select(F.col("parent").alias("id"), "child"), "id").groupBy(F.col("child").alias("id")).agg(F.max("score").alias("score"))
        level = keep(below.join(found.select("id"), "id", "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("depth", F.lit(n)))
        if most is not None and found.count() > most:
            raise ValueError("the descent exceeds its bound")
    return found
