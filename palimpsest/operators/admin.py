"""Plans that a human approves, and what applying them writes: forgetting, revoking, jobs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.secrets import SECRET_ID

#: Which scope each selector may have; a current view is resolved first and may have any.
SCOPES = {"episode": ("occurrence",), "observation": ("occurrence",), "content": ("content",), "state": ("state",), "current": ("occurrence", "content", "state")}
MAX_TARGETS = 1024


def json_list(ids: Column) -> Column:
    """An array of plain ids as a canonical JSON list; empty as []."""
    return F.when(F.size(ids) == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join(ids, '","'), F.lit('"]')))


def plan_forget(selections: DataFrame, current: DataFrame) -> DataFrame:
    """One plan for each selection (request_id, selector, value, scope).

    ``current`` resolves current views and states: id, state_key, content_id,
    observation_id and evidence_ids. Returns request_id, selector, value, scope, targets,
    provenance (sorted evidence), recurrence_blocked, plan_id and error. A selection whose
    scope does not fit its selector, that cannot be resolved, or whose closure is beyond
    1,024 ids has an error and no plan. The id is a hash of the plan's content, whenever
    it is asked for.
    """
    fits = F.lit(False)
    for selector, scopes in SCOPES.items():
        fits |= (F.col("selector") == selector) & F.col("scope").isin(*scopes)
    views = current.select(F.col("id").alias("value"), "state_key", "content_id", "observation_id", F.array_sort(F.array_distinct("evidence_ids")).alias("evidence"))
    joined = selections.join(views.withColumn("selector", F.lit("current")), ["selector", "value"], "left")
    named = lambda scope, column, own: F.when(F.col("scope") == scope, F.coalesce(F.col(column), F.when(F.col("selector").isin(*own), F.col("value"))))
    target = F.coalesce(named("occurrence", "observation_id", ("episode", "observation")), named("content", "content_id", ("content",)), named("state", "state_key", ("state",)))
    planned = joined.withColumns({"target": target, "provenance": F.coalesce("evidence", F.when((F.col("selector") == "episode"), F.array("value")).otherwise(F.array().cast("array<string>")))})
    error = (
        F.when(F.col("value").isNull() | (F.length("value") > 512) | F.col("value").rlike(SECRET_ID), "selector is not plain")
        .when(~F.coalesce(fits, F.lit(False)), "scope does not fit")
        .when(F.col("target").isNull(), "cannot be resolved")
        .when(F.size("provenance") > MAX_TARGETS, "closure is unbounded")
    )
    judged = planned.withColumn("error", error).withColumns({"targets": F.when(error.isNull(), F.array("target")), "recurrence_blocked": F.col("scope") != "occurrence"})
    body = F.concat(F.lit('{"operation":"forget","provenance":'), json_list(F.col("provenance")), F.lit(',"scope":"'), "scope", F.lit('","selection":{"'), "selector", F.lit('":"'), "value", F.lit('"},"targets":'), json_list(F.col("targets")), F.lit("}"))
    out = judged.withColumn("plan_id", F.when(F.col("error").isNull(), F.sha2(body, 256)))
    return out.select("request_id", "selector", "value", "scope", "targets", F.when(F.col("error").isNull(), F.col("provenance")).alias("provenance"), "recurrence_blocked", "plan_id", "error")


def apply_forget(plans: DataFrame, approvals: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Tombstones to append (scope, target_id, plan_id) for the plans that were approved by their exact id.

    A plan's targets are written in its scope and its provenance as occurrences. What is
    there already is not written again, so applying twice changes nothing.
    """
    approved = plans.filter("error IS NULL").join(approvals.select("plan_id").distinct(), "plan_id", "left_semi")
    own = approved.select("plan_id", "scope", F.explode("targets").alias("target_id"))
    evidence = approved.select("plan_id", F.lit("occurrence").alias("scope"), F.explode("provenance").alias("target_id"))
    wanted = own.unionByName(evidence).groupBy("scope", "target_id").agg(F.min("plan_id").alias("plan_id"))
    return wanted.join(tombstones.select("scope", "target_id"), ["scope", "target_id"], "left_anti")


def forget_confirmed(plans: DataFrame, approvals: DataFrame, tombstones: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(plan_id, confirmed): every target has its tombstone, the privacy epoch went up by one, and no generation shows."""
    approved = plans.filter("error IS NULL").join(approvals.select("plan_id").distinct(), "plan_id", "left_semi")
    missing = approved.select("plan_id", "scope", F.explode("targets").alias("target_id")).join(tombstones.select("scope", "target_id"), ["scope", "target_id"], "left_anti").select("plan_id").distinct()
    moved = after.join(before.select("owner_host", F.col("privacy_epoch").alias("_was")), "owner_host").agg(F.coalesce(F.bool_and((F.col("privacy_epoch") == F.col("_was") + 1) & F.col("active_generation").isNull()), F.lit(False)).alias("_moved"))
    marked = approved.select("plan_id").distinct().join(missing.withColumn("_missing", F.lit(True)), "plan_id", "left")
    # one row
    return marked.join(F.broadcast(moved), F.lit(True)).select("plan_id", (F.col("_moved") & F.col("_missing").isNull()).alias("confirmed"))


def plan_revoke(requests: DataFrame, control: DataFrame) -> DataFrame:
    """A plan for each request (owner_host, destinations, reason): epochs from and to, and its id."""
    sorted_ = F.array_sort(F.array_distinct("destinations"))
    rows = requests.join(control.select("owner_host", F.col("privacy_epoch").alias("from_epoch")), "owner_host").withColumns({"destinations": sorted_, "to_epoch": F.col("from_epoch") + 1})
    body = F.concat(F.lit('{"destinations":'), json_list(F.col("destinations")), F.lit(',"from":'), F.col("from_epoch").cast("string"), F.lit(',"operation":"privacy_revoke","owner":"'), "owner_host", F.lit('","reason":"'), "reason", F.lit('","to":'), F.col("to_epoch").cast("string"), F.lit("}"))
    return rows.withColumn("plan_id", F.sha2(body, 256))


def apply_revoke(control: DataFrame, plans: DataFrame, approvals: DataFrame) -> DataFrame:
    """Control rows after the approved plans that are not stale: epoch up, generation gone, destinations revoked for good."""
    approved = plans.join(approvals.select("plan_id").distinct(), "plan_id", "left_semi").groupBy("owner_host", "from_epoch").agg(F.flatten(F.collect_list("destinations")).alias("_more"))
    held = control.join(approved, "owner_host", "left")
    hit = F.coalesce(F.col("privacy_epoch") == F.col("from_epoch"), F.lit(False))
    moved = {
        "revoked": F.when(hit, F.array_sort(F.array_union("revoked", "_more"))).otherwise(F.col("revoked")),
        "active_generation": F.when(~hit, F.col("active_generation")),
        "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")),
        "privacy_epoch": F.when(hit, F.col("privacy_epoch") + 1).otherwise(F.col("privacy_epoch")),
    }
    return held.withColumns(moved).select(*control.columns)


def enqueue(episodes: DataFrame, coverage: DataFrame, operation: str, size: int = 1024) -> DataFrame:
    """Jobs of an admin verb: the uncovered episodes of each policy, in id order, at most ``size`` to a job.

    Returns policy_id, chunk, n and job_id. Episodes are numbered by policy in one pass;
    only ids move.
    """
    from pyspark.sql import Window

    left = episodes.select("id", F.col("processing_policy_id").alias("policy_id")).join(coverage.select("id"), "id", "left_anti")
    placed = left.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("policy_id").orderBy("id")) - 1) / size).cast("long"))
    chunks = placed.groupBy("policy_id", "chunk").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return chunks.select("policy_id", "chunk", F.size("members").cast("long").alias("n"), F.sha2(F.concat(F.lit(f'["{operation}","'), "policy_id", F.lit('",'), json_list(F.col("members")), F.lit("]")), 256).alias("job_id"))


#: Columns that inspection may show; all others, and values that look like secrets, are hidden.
SHOWN = ("id", "record_type", "owner_host", "project_id", "status", "created_at", "event_at", "expires_at", "privacy_epoch", "processing_policy_id", "version", "state", "scope", "resolution", "content_id", "state_key", "content_hash", "secret_scan")


def inspect(records: DataFrame, limit: int) -> DataFrame:
    """Allow-listed metadata of the first records by id, whether more follow, and a hash over what is shown.

    A string that is long, holds control characters or looks like a secret is null. An
    id like that drops its record.
    """
    if not 1 <= limit <= 256:
        raise ValueError("1 to 256 records are inspected at a time")
    fields = [f for f in records.schema.fields if f.name in SHOWN]
    plain = lambda c: (F.length(c) <= 512) & ~F.col(c).rlike(SECRET_ID) & ~F.col(c).rlike(r"[\x00-\x1f\x7f-\x9f]")
    shown = [F.when(plain(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in fields]
    safe = records.select(*shown).filter("id IS NOT NULL").orderBy("id").limit(limit + 1)
    line = F.concat_ws("|", *[F.coalesce(F.col(f.name).cast("string"), F.lit("-")) for f in sorted(fields, key=lambda f: f.name)])
    # one page
    whole = safe.agg((F.count(F.lit(1)) > limit).alias("truncated"), F.sha2(F.array_join(F.slice(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), 1, limit)["line"], "\n"), 256).alias("content_hash"))
    return safe.orderBy("id").limit(limit).join(F.broadcast(whole), F.lit(True))
