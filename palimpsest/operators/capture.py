"""From a session's log entries to episodes: scan, tail, selection, fields, identity and audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.secrets import SECRET_ID
from palimpsest.functions.text import fingerprint

#: Kinds of entries, roles and parts that are never captured.
EXCLUDED_KINDS = ("system", "developer", "custom", "memory", "memory_context")
EXCLUDED_ROLES = (*EXCLUDED_KINDS, "context")
UNFINISHED = ("partial", "aborted", "incomplete")
TOOL_ROLES = ("tool", "toolresult", "tool_result", "function")
OWN_TOOLS = ("memory_search",)
PRIVATE_PART = r"(?i)^(?:thinking|reasoning|signature|thought|redacted_thinking)$"
FAILED_STATUS = r"(?i)^(?:error|failed|failure|non[-_ ]?success|timeout|timed[-_ ]?out|cancel(?:ed|led)|killed|rejected|denied)$"
WRAPPER = r"(?i)<memory[-_]context\b[^>]*>|</memory[-_]context>|\[memory[-_]context\]"
#: Characters of a tool's arguments, of its result, of a text and of an id; places of one entry's parts.
MAX_ARGS, MAX_RESULT, MAX_TEXT, MAX_ID, STRIDE, MAX_SEQUENCE = 2000, 4000, 16_000, 512, 65_536, 2**32 - 1
MAX_AUDIT = 20_000


def safe_id(name: Column) -> Column:
    """Whether an id is bounded, plain and tells no secret."""
    return F.coalesce((F.length(name) <= MAX_ID) & name.rlike(r"^[A-Za-z0-9._:/-]+$") & ~name.rlike(SECRET_ID), F.lit(False))


def entry_scan(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, audit): one unsafe id quarantines the whole batch of its session.

    The audit has a row for each session with unsafe ids, and how many there are.
    """
    audit = entries.filter(~safe_id(F.col("entry_id"))).groupBy("session_id").agg(F.count(F.lit(1)).alias("invalid"))
    return entries.join(audit.select("session_id"), "session_id", "left_anti"), audit


def prefix_hash(ids: Column) -> Column:
    """A hash of ids in order, as a canonical JSON list."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: F.concat(F.lit('"'), i, F.lit('"'))), ","), F.lit("]")), 256)


def after_tail(entries: DataFrame, tails: DataFrame) -> DataFrame:
    """Entries behind each session's durable tail, with their ``place`` in it.

    A tail is (session_id, tail_count, tail_entry_id, tail_hash). Nothing is read from a
    session that is shorter than its tail, whose last captured entry is another one, or
    whose captured ids hash otherwise. A session without a tail is read from its start.
    """
    order = Window.partitionBy("session_id").orderBy("position")
    placed = entries.withColumn("place", F.row_number().over(order).cast("long") - 1)
    held = placed.join(tails, "session_id", "left").withColumn("tail_count", F.coalesce("tail_count", F.lit(0)))
    captured = held.filter(F.col("place") < F.col("tail_count")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("entry_id", "place").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_id"))), lambda x: x["entry_id"]).alias("ids")
    )
    good = captured.select("session_id", "n", "last", prefix_hash(F.col("ids")).alias("hash"))
    matches = (F.col("tail_count") == 0) | ((F.col("n") == F.col("tail_count")) & (F.col("last") == F.col("tail_entry_id")) & (F.col("hash") == F.col("tail_hash")))
    return held.filter(F.col("place") >= F.col("tail_count")).join(good, "session_id", "left").filter(F.coalesce(matches, F.lit(False))).select(*entries.columns, "place")


def sequence(place: Column, part: Column, offset: Column | int = 0) -> Column:
    """The causal sequence of an entry's part within its session; null where it is out of range."""
    at = place + offset
    return F.when((at <= MAX_SEQUENCE // STRIDE) & (part < STRIDE), at * STRIDE + part).cast("long")


def tool_failed() -> Column:
    """Whether a tool's result tells of a failure: a flag, an error, a status, or a code other than zero."""
    parts = [F.col("is_error"), F.trim("error") != "", F.col("status").rlike(FAILED_STATUS), F.col("detail_status").rlike(FAILED_STATUS), F.col("code") != 0, F.col("detail_code") != 0]
    out = F.lit(False)
    for part in parts:
        out |= F.coalesce(part, F.lit(False))
    return out


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def select_entries(entries: DataFrame) -> DataFrame:
    """What of the entries becomes an episode.

    Returns session_id, entry_id, position, event_kind, text, tool_name, tool_args and
    error_fingerprint. Excluded kinds, roles and custom types, unfinished entries,
    private parts, the memory's own tools and wrapped memory go. A call keeps its name
    and the start of its arguments. A result's text is what describes its outcome, and
    its body only where it failed; a result with nothing to say goes unless it failed.
    """
    kind, role = F.lower("entry_type"), F.lower("role")
    excluded = kind.isin(*EXCLUDED_KINDS)
    for k in EXCLUDED_KINDS:
        excluded |= kind.startswith(f"{k}_")
    open_ = F.lower(F.coalesce("status", F.lit(""))).isin(*UNFINISHED) | F.coalesce("aborted", F.lit(False))
    custom = F.coalesce(F.col("custom_type").rlike(r"(?i)memory|context|system|developer"), F.lit(False))
    kept = entries.filter(~excluded & ~open_ & ~custom & ~role.isin(*EXCLUDED_ROLES))
    own = F.coalesce(F.col("name").isin(*OWN_TOOLS), F.lit(False))
    spoken, result = role.isin("user", "assistant"), role.isin(*TOOL_ROLES)
    call = spoken & F.col("name").isNotNull() & F.lower("part_type").rlike("tool(?:call|_call)|function")
    private = F.col("part_type").rlike(PRIVATE_PART)
    failed = tool_failed()
    status = F.coalesce("status", "detail_status")
    code = F.coalesce("code", "detail_code")
    body = F.when(failed, F.concat_ws("\n", "text", _line("stderr", F.col("stderr")), _line("status", status), _line("code", code), _line("error", F.col("error"))))
    told = F.concat_ws("\n", _line("status", status), _line("code", code), F.when(F.trim("stderr") != "", _line("stderr", F.col("stderr"))))
    outcome = F.left(F.when(failed, body).otherwise(told), F.lit(MAX_RESULT))
    wrapped = F.coalesce(F.col("text").rlike(WRAPPER), F.lit(False))
    event = F.when(call, "tool_call").when(spoken, role).when(failed, "tool_error").otherwise("tool_result")
    text = F.when(call, F.lit(None)).when(spoken, F.left("text", F.lit(MAX_TEXT))).otherwise(F.when(outcome != "", outcome))
    keep = F.when(spoken, ~private & F.when(call, ~own).otherwise((F.coalesce("text", F.lit("")) != "") & ~wrapped)).when(result, ~own & ~wrapped & (failed | (outcome != ""))).otherwise(False)
    chosen = kept.filter(keep).select(
        "session_id", "entry_id", "position", event.alias("event_kind"), text.alias("text"),
        F.when(call | result, F.col("name")).alias("tool_name"),
        F.when(call | (result & failed), F.left("arguments", F.lit(MAX_ARGS))).alias("tool_args"),
    )
    return chosen.withColumn("error_fingerprint", F.when(F.col("event_kind") == "tool_error", fingerprint(F.col("text"))))


def semantic_text() -> Column:
    """The one text of an episode that leaves for embedding; a fingerprint shows only that it is there."""
    part = lambda label, c: F.concat(F.lit(f"{label}:"), c)
    return F.concat_ws("\n", part("event", "event_kind"), part("tool", "tool_name"), part("text", "text"), part("tool_args", "tool_args"), F.when(F.col("error_fingerprint").isNotNull(), "error_fingerprint:present"))


def safe_text() -> Column:
    """What an episode shows: its text, else its tool, else its kind."""
    named = F.concat(F.when(F.col("event_kind") == "tool_error", "Tool error: ").otherwise("Tool: "), "tool_name")
    return F.when(F.trim("text") != "", F.col("text")).when(F.col("tool_name").isNotNull(), named).otherwise(F.concat(F.lit("Memory event: "), "event_kind"))


def audit_counts(quarantined: DataFrame, most: int = MAX_AUDIT) -> DataFrame:
    """Quarantined entries by category, each id once, counted up to a fixed bound."""
    return quarantined.groupBy("category").agg(F.least(F.countDistinct("quarantine_id"), F.lit(most)).alias("n"))


def resolve_marker(style: Column, header_depth: Column, env_depth: Column, parent: Column, child_flag: Column) -> Column:
    """Root or child, depth and validity from a session's markers, as a struct.

    Style "depth" reads a depth from the header and from the environment; they must be
    numbers up to 1,000 and agree. Style "parent" reads a parent session, and a flag and
    a depth from the environment, which must not contradict it. Markers that are not
    valid make a child, and only a valid root may do root work.
    """
    number = lambda c: F.when(c.rlike(r"^[0-9]{1,4}$"), c).cast("int")
    bounded = lambda c: F.when(number(c) <= 1000, number(c))
    h, e = bounded(header_depth), bounded(env_depth)
    known = (header_depth.isNull() | h.isNotNull()) & (env_depth.isNull() | e.isNotNull())
    by_depth = style == "depth"
    depth_valid = known & (h.isNull() | e.isNull() | (h == e))
    depth = F.coalesce(h, e, F.lit(0))
    flagged = F.coalesce(child_flag == "1", F.lit(False)) | F.coalesce(e > 0, F.lit(False)) | parent.isNotNull()
    parent_valid = (env_depth.isNull() | e.isNotNull()) & (child_flag.isNull() | child_flag.isin("0", "1")) & ~(F.coalesce(child_flag == "0", F.lit(False)) & flagged) & ~(F.coalesce(e == 0, F.lit(False)) & flagged)
    valid = F.when(by_depth, depth_valid).otherwise(parent_valid)
    marked = F.when(by_depth, depth > 0).otherwise(flagged)
    at = F.when(by_depth, depth).otherwise(F.when(flagged, F.greatest(F.lit(1), F.coalesce(e, F.lit(1)))).otherwise(0))
    child = marked | ~valid
    return F.struct(
        F.when(child, "child").otherwise("root").alias("role"),
        F.when(~valid & ~marked, F.greatest(F.lit(1), at)).otherwise(at).cast("long").alias("depth"),
        valid.alias("valid"),
        (valid & ~child).alias("root_work"),
    )


def curation_trigger(root_work: Column, turns: Column, calls: Column, compacting: Column, closing: Column, most_turns: int = 10, most_calls: int = 15) -> Column:
    """What a lifecycle event sets off: child, persist_only, run or disabled."""
    due = compacting | (turns >= most_turns) | (calls >= most_calls)
    return F.when(~root_work, "child").when(closing, "persist_only").when(due, "run").otherwise("disabled")


def allowed_project(allow: Sequence[str], deny: Sequence[str], column: str = "project_id") -> Column:
    """Denied projects never pass; an empty list of allowed ones allows all, another needs a project on it."""
    project = F.col(column)
    denied = F.coalesce(project.isin(list(deny)), F.lit(False)) if deny else F.lit(False)
    listed = F.coalesce(project.isin(list(allow)), F.lit(False)) if allow else F.lit(True)
    return ~denied & listed
