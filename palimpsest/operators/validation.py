"""What makes a record or a curated item valid: the first rule that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.secrets import SECRET_ID

HOSTS = ("alpha", "beta")
#: Bounds of ids, texts, lists and numbers, and the years that a time may have, in milliseconds.
MAX_ID, MAX_TEXT, MAX_LIST, MAX_UINT, FIRST_MS, LAST_MS = 512, 16_000, 1024, 2**32 - 1, 0, 4_133_980_799_999
#: The fields of each record type; any other is refused.
ENVELOPE = ("record_type", "id", "owner_host", "schema_revision", "created_at", "privacy_epoch", "processing_policy_id", "expires_at", "content_hash")
DERIVED = ("coordination_policy_hash", "coordination_policy_epoch")
FIELDS = {
    "episode": (*ENVELOPE, "project_id", "session_id", "agent_role", "depth", "event_kind", "event_at", "status", "secret_scan", "text", "tool_name", "session_sequence"),
    "curated_memory": (*ENVELOPE, "content_id", "observation_id", "effective_at", "source_episode_ids", "confidence", "text", "state_key", "scope"),
    "lease": (*ENVELOPE, "job_id", "owner_id", "version", "fencing_token", "state", "accepted_proposal_id", "accepted_manifest_hash"),
    "tombstone": (*ENVELOPE, "scope", "target_id"),
    "job": (*ENVELOPE, *DERIVED, "policy_id", "policy_hash", "policy_epoch", "membership", "extractor_revision"),
    "proposal": (*ENVELOPE, *DERIVED, "job_id", "owner_id", "proposal_hash", "manifest_hash", "fencing_token", "membership"),
    "coverage": (*ENVELOPE, *DERIVED, "episode_id", "extractor_revision"),
    "evidence_link": (*ENVELOPE, *DERIVED, "source_id", "target_id", "job_id", "extractor_revision"),
    "conflict_manifest": (*ENVELOPE, *DERIVED, "state_key", "members"),
    "collection_control": (*ENVELOPE, *DERIVED, "version", "active_generation", "active_base_generation", "state", "scan_cursor", "last_forget_barrier", "revoked_destination_ids"),
    "processing_policy": (*ENVELOPE, "policy_id", "policy_owner_host", "policy_expires_at", "canonical_hash"),
    "curated_current": (*ENVELOPE, *DERIVED, "version", "state_key", "project_id", "scope", "resolution", "content_id", "observation_id", "text", "conflict_manifest_hash", "source_episode_ids"),
    "raptor_summary": (*ENVELOPE, *DERIVED, "generation_id", "cluster_id", "membership_hash", "level", "member_ids", "manifest_hash", "summary", "model_id", "embedding_dimension", "prompt_revision", "algorithm", "seed", "job_id", "fencing_token", "temporal_from", "temporal_to", "covered_projects", "algorithm_parameters"),
}
#: Members of a job, dimensions of a vector, characters of parameters and of a destination.
MAX_MEMBERS, DIMENSIONS, MAX_PARAMETERS, DESTINATION = 65_536, 1024, 4096, r"^[A-Za-z0-9._:/-]{1,256}$"
CATEGORIES = ("preference", "correction", "convention", "fact", "failure", "learning")
SCOPES = ("project", "session", "host", "global")
#: Items of a result, evidence of an item, characters of a field and of a value.
MAX_ITEMS, MAX_EVIDENCE, MAX_FIELD, MAX_VALUE = 32, 16, 512, 4096
ITEM_SECRET = r"(?i)(?:api[-_]?key|access[-_]?token|authorization|bearer|credential|password|secret|token)"


def _text(name: str, most: int = MAX_ID, secret: bool = False) -> Column:
    """Whether a field is no bounded text."""
    c = F.col(name)
    bad = c.isNull() | (c == "") | (F.length(c) > most)
    return bad | F.coalesce(c.rlike(SECRET_ID), F.lit(False)) if secret else bad


def _number(name: str, least: int = 0, most: int = MAX_UINT) -> Column:
    return ~F.coalesce(F.col(name).between(least, most), F.lit(False))


def _time(name: str, nullable: bool = False) -> Column:
    bad = ~F.coalesce(F.col(name).between(FIRST_MS, LAST_MS), F.lit(False))
    return bad & F.col(name).isNotNull() if nullable else bad


def _one_of(name: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(name).isin(*values), F.lit(False))


def _sorted(name: str) -> Column:
    """Whether a list of ids is empty, too long, or not strictly sorted."""
    ids = F.col(name)
    return ids.isNull() | (F.size(ids) < 1) | (F.size(ids) > MAX_LIST) | (F.array_sort(F.array_distinct(ids)) != ids)


def _optional(name: str, secret: bool = False) -> Column:
    return F.col(name).isNotNull() & _text(name, secret=secret)


def _ids(name: str, least: int = 1, most: int = MAX_LIST, ordered: bool = True) -> Column:
    """Whether a list holds too few or too many ids, one that is no bounded plain text, or, if ordered, is not strictly sorted."""
    ids = F.col(name)
    plain = F.forall(ids, lambda x: x.isNotNull() & (F.length(x) > 0) & (F.length(x) <= MAX_ID) & ~x.rlike(SECRET_ID))
    good = F.size(ids).between(least, most) & plain & ((F.array_sort(F.array_distinct(ids)) == ids) if ordered else F.lit(True))
    return ~F.coalesce(ids.isNotNull() & good, F.lit(False))


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _digest(name: str) -> Column:
    """The hash of a list of ids, in their order, as a JSON list."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(name, '","'), F.lit('"]')), 256)


def _coordination_rules(record_type: str) -> list[tuple[str, Column]]:
    """Rules of jobs and what comes of them: proposals, coverage, links, conflicts, summaries, control and policies."""
    policy = [("coordination hash", _text("coordination_policy_hash")), ("coordination epoch", _number("coordination_policy_epoch"))]
    revision, job = ("extractor", _text("extractor_revision", secret=True)), ("job", _text("job_id", secret=True))
    resolved, conflict = F.col("resolution") == "resolved", F.col("resolution") == "conflict"
    chosen = F.col("content_id").isNotNull() | F.col("observation_id").isNotNull() | F.col("text").isNotNull()
    revoked = F.col("revoked_destination_ids")
    plain = F.forall(revoked, lambda d: d.isNotNull() & d.rlike(DESTINATION) & ~d.rlike(SECRET_ID))
    rules = {
        "job": lambda: [
            *policy, ("job policy", _text("policy_id", secret=True) | _differ("policy_id", "processing_policy_id")), ("policy hash", _text("policy_hash") | _differ("policy_hash", "coordination_policy_hash")),
            ("policy epoch", _number("policy_epoch") | _differ("policy_epoch", "coordination_policy_epoch")), ("membership", _ids("membership", most=MAX_MEMBERS)), revision,
        ],
        "proposal": lambda: [
            *policy, job, ("holder", _text("owner_id", secret=True)), ("proposal hash", ~F.coalesce(F.col("proposal_hash").rlike("^[0-9a-f]{64}$"), F.lit(False))), ("fence", _number("fencing_token")),
            ("membership", _ids("membership")), ("manifest", ~F.coalesce(F.col("manifest_hash") == _digest("membership"), F.lit(False))),
        ],
        "coverage": lambda: [*policy, ("episode", _text("episode_id", secret=True)), revision],
        "evidence_link": lambda: [*policy, ("source", _text("source_id", secret=True)), ("target", _text("target_id", secret=True)), job, revision],
        "conflict_manifest": lambda: [*policy, ("state key", _text("state_key")), ("members", _ids("members", 2))],
        "collection_control": lambda: [
            *policy, ("version", _number("version", 1)), ("generation", _optional("active_generation") | _optional("active_base_generation")), ("state", _one_of("state", ("active", "draining", "retired"))),
            ("cursor", _optional("scan_cursor")), ("barrier", _time("last_forget_barrier", nullable=True)), ("destinations", ~F.coalesce((F.size(revoked) <= MAX_LIST) & plain & (F.size(F.array_distinct(revoked)) == F.size(revoked)) & revoked.isNotNull(), F.lit(False))),
        ],
        "processing_policy": lambda: [("policy owner", _differ("policy_owner_host", "owner_host")), ("policy envelope", _differ("policy_expires_at", "expires_at") | _differ("policy_id", "processing_policy_id")), ("policy hash", _differ("canonical_hash", "id") | _differ("canonical_hash", "policy_id"))],
        "curated_current": lambda: [
            *policy, ("version", _number("version", 1)), ("state key", _text("state_key")), ("project", _optional("project_id", secret=True)), ("scope", _optional("scope")), ("resolution", _one_of("resolution", ("resolved", "conflict"))),
            ("resolved", resolved & (_text("content_id", secret=True) | _text("observation_id", secret=True) | _text("text", MAX_TEXT) | F.col("conflict_manifest_hash").isNotNull())),
            ("conflict", conflict & (chosen | _text("conflict_manifest_hash"))), ("sources", F.col("source_episode_ids").isNotNull() & _ids("source_episode_ids")),
        ],
        "raptor_summary": lambda: [
            *policy, ("generation", _text("generation_id", secret=True)), ("cluster", _text("cluster_id", secret=True)), ("level", _number("level")), ("closure", F.col("member_ids").isNull() & F.col("manifest_hash").isNull()), ("manifest", _optional("manifest_hash")),
            ("members", F.col("member_ids").isNotNull() & _ids("member_ids", ordered=False)), ("membership hash", _text("membership_hash") | (F.col("member_ids").isNotNull() & (F.col("membership_hash") != _digest("member_ids")))), ("summary", _text("summary", MAX_TEXT)),
            ("model", _text("model_id", secret=True)), ("dimension", ~F.coalesce(F.col("embedding_dimension") == DIMENSIONS, F.lit(False))), ("prompt", _text("prompt_revision")), ("algorithm", _text("algorithm")), ("seed", _number("seed")), job, ("fence", _number("fencing_token")),
            ("range", _time("temporal_from") | _time("temporal_to") | (F.col("temporal_from") > F.col("temporal_to"))), ("projects", _ids("covered_projects", ordered=False)), ("parameters", F.length("algorithm_parameters") > MAX_PARAMETERS),
        ],
    }
    return rules[record_type]()


def _rules(record_type: str) -> list[tuple[str, Column]]:
    common = [
        ("id", _text("id", secret=True)), ("owner", _one_of("owner_host", HOSTS)), ("revision", ~F.coalesce(F.col("schema_revision") == 1, F.lit(False))), ("created", _time("created_at")),
        ("epoch", _number("privacy_epoch")), ("policy", _text("processing_policy_id", secret=True)), ("expiry", _time("expires_at", nullable=record_type != "lease")), ("hash", _text("content_hash")),
    ]
    pair = F.col("accepted_proposal_id").isNull() != F.col("accepted_manifest_hash").isNull()
    target = F.when(F.col("scope") == "occurrence", F.col("target_id").rlike(r"^(occurrence:[0-9a-f]{64}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$")).when(F.col("scope") == "content", F.col("target_id").rlike(r"^content:[0-9a-f]{64}$")).otherwise(F.col("target_id").rlike(r"^state:[0-9a-f]{64}$"))
    own = {
        "episode": lambda: [
            ("project", _text("project_id", secret=True)), ("session", _text("session_id", secret=True)), ("role", _one_of("agent_role", ("root", "child"))), ("depth", _number("depth")),
            ("kind", _one_of("event_kind", ("user", "assistant", "tool_call", "tool_result", "tool_error"))), ("event", _time("event_at")), ("status", _one_of("status", ("active",))), ("scan", _one_of("secret_scan", ("passed",))),
            ("text", F.col("text").isNotNull() & _text("text", MAX_TEXT)), ("tool", F.col("tool_name").isNotNull() & _text("tool_name")), ("sequence", F.col("session_sequence").isNotNull() & _number("session_sequence")),
        ],
        "curated_memory": lambda: [
            ("content", _text("content_id", secret=True)), ("observation", ~F.coalesce(F.col("observation_id") == F.col("id"), F.lit(False))), ("effective", _time("effective_at")), ("sources", _sorted("source_episode_ids")),
            ("confidence", F.col("confidence").isNotNull() & ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))), ("text", F.col("text").isNotNull() & _text("text", MAX_TEXT)),
        ],
        "lease": lambda: [
            ("job", _text("job_id", secret=True)), ("holder", _text("owner_id", secret=True)), ("version", _number("version", 1)), ("fence", _number("fencing_token")), ("state", _one_of("state", ("leased", "accepted", "released", "completed"))), ("pair", pair),
            ("leased", (F.col("state") == "leased") & F.col("accepted_proposal_id").isNotNull()), ("accepted", F.col("state").isin("accepted", "completed") & F.col("accepted_proposal_id").isNull()),
        ],
        "tombstone": lambda: [("scope", _one_of("scope", ("occurrence", "content", "state"))), ("target", ~F.coalesce(target, F.lit(False)))],
    }
    return common + (own[record_type]() if record_type in own else _coordination_rules(record_type))


def validate(records: DataFrame, record_type: str) -> DataFrame:
    """Records of one type with ``reason``: the first rule that each breaks, or valid.

    A column that the type does not have is an error, whatever it holds. Ids made of a
    record's content are not worked out here, but for the hash of a list of members.
    """
    if unknown := sorted(set(records.columns) - set(FIELDS[record_type])):
        raise ValueError(f"{record_type} has no field {unknown[0]}")
    reason = None
    for name, broken in _rules(record_type):
        reason = F.when(broken, name) if reason is None else reason.when(broken, name)  # a null rule is not broken
    return records.withColumn("reason", reason.otherwise("valid"))


def validate_items(items: DataFrame, episodes: DataFrame, max_items: int = MAX_ITEMS, max_evidence: int = MAX_EVIDENCE) -> DataFrame:
    """(result_id, item, reason) for the items of curation results.

    Items have result_id, item, category, scope, subject, predicate, value (JSON text),
    text, evidence and confidence; ``episodes`` are the result's members: result_id,
    episode_id and direct, whether a user said it. The first rule that an item breaks is
    its reason; what concerns the whole result comes last and marks all its items.
    """
    field = lambda c, most=MAX_FIELD: F.col(c).isNull() | (F.col(c) == "") | (F.length(c) > most) | F.coalesce(F.col(c).rlike(ITEM_SECRET), F.lit(False))
    n = F.size(F.coalesce("evidence", F.array().cast("array<string>")))
    links = items.select("result_id", "item", F.explode("evidence").alias("episode_id")).distinct().join(episodes.select("result_id", "episode_id", "direct"), ["result_id", "episode_id"], "left")
    found = links.groupBy("result_id", "item").agg(F.bool_or(F.col("direct").isNull()).alias("_foreign"), F.coalesce(F.bool_or("direct"), F.lit(False)).alias("_direct"))
    same = Window.partitionBy("result_id", "category", "scope", "subject", "predicate", "value", "text", F.col("evidence").cast("string"), "confidence")
    sizes = items.groupBy("result_id").agg(F.count(F.lit(1)).alias("_items"))
    joined = items.withColumn("_same", F.count(F.lit(1)).over(same)).join(found, ["result_id", "item"], "left").join(sizes, "result_id")
    reason = (
        F.when(_one_of("category", CATEGORIES), "category")
        .when(_one_of("scope", SCOPES), "scope")
        .when(field("subject"), "subject")
        .when(field("predicate"), "predicate")
        .when(F.col("value").isNotNull() & (F.length("value") > MAX_VALUE), "value")
        .when(F.col("text").isNotNull() & field("text", MAX_TEXT), "text")
        .when(F.col("value").isNull() & F.col("text").isNull(), "empty")
        .when(F.col("confidence").isNotNull() & (F.isnan("confidence") | ~F.col("confidence").between(0.0, 1.0)), "confidence")
        .when((n < 1) | (n > max_evidence), "evidence")
        .when(F.exists("evidence", lambda e: ~e.rlike(r"^[A-Za-z0-9._:/-]{1,512}$") | e.rlike(ITEM_SECRET)), "evidence id")
        .when(F.size(F.array_distinct("evidence")) < n, "repeated evidence")
        .when(F.coalesce("_foreign", F.lit(True)), "foreign evidence")
        .when(F.col("category").isin("preference", "correction") & ~F.col("_direct"), "no direct evidence")
        .when(F.col("_same") > 1, "repeated item")
        .when(F.col("_items") > max_items, "too many items")
        .otherwise("valid")
    )
    return joined.select("result_id", "item", reason.alias("reason"))
