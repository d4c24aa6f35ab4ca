"""Temporal state: intervals, folds, effective orders and the current-value machine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.identity import logical_id

STREAM = ["policy_epoch", "state_key", "scope", "project_id"]


def history_intervals(observations: DataFrame) -> DataFrame:
    """Chronological intervals of a state; adjacent equal contents are one, A-B-A stays three."""
    stream = Window.partitionBy(*STREAM).orderBy("effective_at", "id")
    changed = observations.withColumn("before", F.lag("content_id").over(stream)).filter("before IS NULL OR before <> content_id")
    return changed.withColumn("valid_to", F.lead("effective_at").over(stream)).select(*STREAM, "id", "content_id", F.col("effective_at").alias("valid_from"), "valid_to")


def fold_segments(observations: DataFrame, stream: Sequence[str] = ("state_key",)) -> DataFrame:
    """Runs of equal content of a state within a stream, with their observations counted and bounded.

    The next segment closes one. A stream of several states is folded as one sequence, so
    there the next segment of any state closes one; by state, its own next.
    """
    keys = list(stream)
    order = Window.partitionBy(*keys).orderBy("effective_at", "id")
    same = (F.lag("content_id").over(order) == F.col("content_id")) & (F.lag("state_key").over(order) == F.col("state_key"))
    marked = observations.withColumn("new", F.when(same, 0).otherwise(1))
    numbered = marked.withColumn("segment", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.min("state_key").alias("state_key")] if "state_key" not in keys else []
    segments = numbered.groupBy(*keys, "segment").agg(*more, F.min("content_id").alias("content_id"), F.min("effective_at").alias("valid_from"), F.count(F.lit(1)).alias("n_observations"), F.max_by("evidence_id", F.struct("effective_at", "id")).alias("primary_evidence"))
    return segments.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("segment")))


def as_of(intervals: DataFrame, at: int) -> DataFrame:
    """The interval of each state that holds at a time."""
    return intervals.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def compare_orders(a_time: Column, b_time: Column, a_content: Column, b_content: Column, skew: int, a_session: tuple[Column, Column] | None = None, b_session: tuple[Column, Column] | None = None) -> Column:
    """before, after, equal or within_skew for two orders.

    Within one session (id and sequence of each) the sequence decides, whatever the clocks
    say; across sessions the time does, and in the skew window equal content is equal.
    """
    across = F.when(F.abs(a_time - b_time) <= skew, F.when(a_content == b_content, "equal").otherwise("within_skew")).when(a_time < b_time, "before").otherwise("after")
    if a_session is None or b_session is None:
        return across
    (a_id, a_at), (b_id, b_at) = a_session, b_session
    within = F.when(a_at < b_at, "before").when(a_at > b_at, "after").when(a_content == b_content, "equal").otherwise("within_skew")
    return F.when(a_id == b_id, within).otherwise(across)


def decide(current_kind: Column, same_content: Column, comparison: Column) -> Column:
    """What an arrival does to the current value: one step of the machine."""
    resolved = (
        F.when(same_content, F.when(comparison == "before", "update").otherwise("converge"))
        .when(comparison == "within_skew", "conflict")
        .when(comparison == "equal", "converge")
        .when(comparison == "before", "update")
        .otherwise("late")
    )
    conflict = F.when(comparison == "within_skew", "conflict_grow").when(comparison == "equal", "converge").when(comparison == "before", "update").otherwise("late")
    return F.when(current_kind.isNull(), "insert").when(current_kind == "resolved", resolved).otherwise(conflict)


def arrived(now: dict | None, at: int, content: str, skew: int) -> dict:
    """The current value of a state after one more observation: kind, content, at, members, version.

    A later one replaces it, one within the skew window opens or widens a conflict, and
    equal and earlier ones change nothing. The same value is returned where nothing changes.
    """
    if now is None:
        return {"kind": "resolved", "content": content, "at": at, "members": {content}, "version": 1}
    if at - now["at"] > skew:
        return {"kind": "resolved", "content": content, "at": at, "members": {content}, "version": now["version"] + 1}
    tied = abs(at - now["at"]) <= skew and content != now["content"]
    if not tied or (now["kind"] == "conflict" and content in now["members"]):
        return now
    members = now["members"] | {content}
    return {"kind": "conflict", "content": max(members), "at": max(now["at"], at), "members": members, "version": now["version"] + 1}


def fold_current(observations: DataFrame, skew: int) -> DataFrame:
    """The current value of each state after all arrivals, in order of (created_at, id).

    Ties in the skew window make the outcome depend on arrival order, so the fold is
    sequential. Rows stream through it sorted; a state keeps its value and the members
    of an open conflict, so no state's history is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        now: dict | None = None
        for batch in batches:
            out = []
            for state, at, content, ident in batch[["state_key", "effective_at", "content_id", "id"]].itertuples(index=False):
                if state != key:
                    if key is not None:
                        out.append((key, now["kind"], now["content"], now["at"], sorted(now["members"]), now["version"]))
                    key, now = state, None
                now = arrived(now, at, content, skew)
            yield pd.DataFrame(out, columns=["state_key", "kind", "content", "at", "members", "version"])
        if key is not None:
            yield pd.DataFrame([(key, now["kind"], now["content"], now["at"], sorted(now["members"]), now["version"])], columns=["state_key", "kind", "content", "at", "members", "version"])

    ordered = observations.select("state_key", "effective_at", "content_id", "id", "created_at").repartition("state_key").sortWithinPartitions("state_key", "created_at", "id")
    return ordered.mapInPandas(run, "state_key string, kind string, content string, at long, members array<string>, version long")


def effective_order(evidence: DataFrame) -> DataFrame:
    """The order of each item: its session's largest sequence, or its latest evidence."""
    return evidence.groupBy("item_id").agg(
        F.when((F.countDistinct("session_id") == 1) & (F.count("session_sequence") == F.count(F.lit(1))), "session").otherwise("tuple").alias("kind"),
        F.max("session_sequence").alias("max_sequence"),
        F.max_by("id", F.struct("event_at", "id")).alias("primary_evidence"),
        F.max("event_at").alias("event_at"),
    )


def project_items(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """Curated items (item, scope, evidence_ids) on their evidence: error, project_id, primary_id and event_at.

    All evidence must resolve; that of a project's item must be of one project, that of a
    session's of one session. The primary evidence is the latest, then that with the
    largest id.
    """
    known = episodes.select(F.col("id").alias("evidence_id"), "project_id", "session_id", "event_at")
    links = items.select("item", "scope", F.explode("evidence_ids").alias("evidence_id")).join(known, "evidence_id", "left")
    sums = links.groupBy("item", "scope").agg(
        F.bool_or(F.col("session_id").isNull()).alias("_lost"),
        F.countDistinct(F.coalesce("project_id", F.lit(""))).alias("_projects"),
        F.countDistinct("session_id").alias("_sessions"),
        F.min("project_id").alias("_project"),
        F.max(F.when(F.col("session_id").isNotNull(), F.struct("event_at", "evidence_id"))).alias("_primary"),
    )
    error = F.when(F.col("_lost"), "evidence is missing").when((F.col("scope") == "project") & (F.col("_projects") != 1), "several projects").when((F.col("scope") == "session") & (F.col("_sessions") != 1), "several sessions")
    good = F.col("error").isNull()
    return sums.withColumn("error", error).select("item", "scope", "error", F.when(good & (F.col("scope") == "project"), F.col("_project")).alias("project_id"), F.when(good, F.col("_primary.evidence_id")).alias("primary_id"), F.when(good, F.col("_primary.event_at")).alias("event_at"))


def conflicts(observations: DataFrame, conflict: Sequence[str]) -> DataFrame:
    """Manifests of conflicts, one for each value of the ``conflict`` columns with two contents or more.

    A content is represented by its latest observation, then that with the largest id;
    everything else, as members, sources, times and the id, comes of the representatives
    alone, so the order of arrival does not show.
    """
    keys = list(conflict)
    each = observations.groupBy(*keys, "content_id").agg(F.max(F.struct("effective_at", "id", "evidence_id")).alias("r"))
    found = each.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("r.id")), ",").alias("members"),
        F.array_join(F.array_sort(F.collect_set("r.evidence_id")), ",").alias("sources"),
        F.max("r.effective_at").alias("latest_at"),
        F.min("r.effective_at").alias("created_at"),
        F.count(F.lit(1)).alias("n_contents"),
    )
    return found.filter("n_contents >= 2").withColumn("manifest_id", logical_id("conflict", F.col("state_key"), F.replace("members", F.lit(","), F.lit("|"))))
