"""Hybrid retrieval as one lazy plan: guards, lanes, rank fusion, barriers, packing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import normalize_nfkc

RRF_CONSTANT = 60
MAX_TERMS = 32
MAX_RESULTS = 10

_LANE_TIME = {"episodes": "event_at", "historical": "effective_at", "raptor": "temporal_to"}
_LANE_TYPES = {"episodes": ["episode"], "current": ["curated_current"], "historical": ["curated_memory"], "curated": ["curated_memory", "curated_current"], "raptor": ["raptor_summary"], "exact": ["episode", "curated_memory", "curated_current"]}
_POLICY_LANES, _GLOBAL_LANES = {"current", "historical", "curated", "raptor"}, {"current", "historical", "curated", "exact"}


def not_expired(now: int, skew: int, column: str = "expires_at") -> Column:
    return F.col(column).isNull() | (F.col(column) > now + skew)


def read_guard(owner: str, privacy_epoch: int, now: int, skew: int) -> Column:
    """What every read of records must pass."""
    return (F.col("owner_host") == owner) & (F.col("status") == "active") & (F.col("secret_scan") == "passed") & (F.col("privacy_epoch") == privacy_epoch) & not_expired(now, skew)


#: Record types that are control state; their expiry is a lease's, not a memory's.
COORDINATION_TYPES = ("collection_control", "processing_policy", "job", "lease", "proposal", "coverage", "evidence_link", "tombstone", "collection_metadata")
PURPOSES = ("query", "internal", "write_verification", "metadata")


def read_policy(owner: str, types: Sequence[str], now: int, skew: int, purpose: str = "query", project: str | None = None, policy: str | None = None, privacy_epoch: int | None = None) -> Column:
    """The predicate of a read: owner, types, status, scan, scope and expiry.

    Coordination records are exempt from expiry, and tombstones can be read for internal
    purposes only.
    """
    if not types or purpose not in PURPOSES:
        raise ValueError("a read policy needs record types and a purpose")
    keep = (F.col("owner_host") == owner) & (F.col("status") == "active") & (F.col("secret_scan") == "passed") & F.col("record_type").isin(list(types))
    if purpose != "metadata":
        keep &= F.col("record_type").isin(*COORDINATION_TYPES) | not_expired(now, skew)
    if purpose not in ("internal", "write_verification"):
        keep &= F.col("record_type") != "tombstone"
    for column, wanted in (("project_id", project), ("processing_policy_id", policy), ("privacy_epoch", privacy_epoch)):
        if wanted is not None:
            keep &= F.col(column) == wanted
    return keep


def lane_filter(lane: str, owner: str, project: str, privacy_epoch: int, now: int, skew: int, policy_epoch: int = 1, is_global: bool = False, generation: str | None = None, after: int | None = None, before: int | None = None, typed: bool = False) -> Column:
    """The mandatory predicate of a lane; wrong scopes are refused, not emptied."""
    if lane not in _LANE_TYPES:
        raise ValueError(f"unknown lane {lane}")
    keep = read_guard(owner, privacy_epoch, now, skew)
    if typed:
        keep &= F.col("record_type").isin(_LANE_TYPES[lane])
    if lane in _POLICY_LANES:
        keep &= F.col("policy_epoch") == policy_epoch
    if is_global:
        if lane not in _GLOBAL_LANES:
            raise ValueError("a global scope does not exist in this lane")
        keep &= F.col("scope") == "global"
    elif lane in ("episodes", "exact"):
        keep &= F.col("project_id") == project
    elif lane == "raptor":
        if not generation:
            raise ValueError("an active generation is required")
        keep &= F.array_contains("covered_projects", project) & (F.col("generation_id") == generation)
    else:
        keep &= (F.col("scope") == "project") & (F.col("project_id") == project)
    time = F.col(_LANE_TIME.get(lane, "created_at"))
    if after is not None:
        keep &= time >= after
    if before is not None:
        keep &= time <= before
    return keep


def predicate(spec: dict) -> Column:
    """A condition tree as a Column: must, must_not, should over match, any, range, is_null.

    A match on an array column holds if any element matches.
    """

    def one(c: dict) -> Column:
        if "is_null" in c:
            return F.col(c["is_null"]).isNull()
        column = F.col(c["key"])
        if "match" in c:
            wanted = c["match"] if isinstance(c["match"], list) else [c["match"]]
            return F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if c.get("array") else column.isin(wanted)
        sides = {"gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__}
        out = F.lit(True)
        for side, bound in c["range"].items():
            out &= sides[side](bound)
        return out

    out = F.lit(True)
    for c in spec.get("must", ()):
        out &= F.coalesce(one(c), F.lit(False))
    for c in spec.get("must_not", ()):
        out &= ~F.coalesce(one(c), F.lit(False))
    if should := spec.get("should"):
        some = F.lit(False)
        for c in should:
            some |= F.coalesce(one(c), F.lit(False))
        out &= some
    return out


def exact_terms(query: str) -> list[str]:
    """Normalised search terms of a query, at most 32."""
    folded = unicodedata.normalize("NFKC", query).lower()
    kept = "".join(ch if ch.isalnum() or ch in "._:/-" else " " for ch in folded)
    return re.findall(r"\S+", kept)[:MAX_TERMS]


def contains_terms(text: Column, terms: Sequence[str]) -> Column:
    """Whether every term is within the text, both in compatibility form and lower case; no term matches nothing."""
    if not terms:
        return F.lit(False)
    folded = F.lower(normalize_nfkc(text))
    out = folded.contains(terms[0])
    for term in terms[1:]:
        out &= folded.contains(term)
    return F.coalesce(out, F.lit(False))


def dot(vector: Column, query: Sequence[float]) -> Column:
    pairs = F.zip_with(vector.cast("array<double>"), F.array(*[F.lit(float(q)) for q in query]), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "vec_id", least: float | None = None) -> DataFrame:
    """Exact top-k by dot product; ties go to the smaller id. One pass and a bounded heap a task."""
    scored = vectors.withColumn("score", F.round(dot(F.col("embedding"), query), 6)).filter(~F.isnan("score"))
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def rank_lanes(candidates: DataFrame, per_lane: int | None = None) -> DataFrame:
    """Rank within each lane by score, then id; non-finite scores go first of all."""
    finite = candidates.filter(F.col("raw_score").isNotNull() & ~F.isnan("raw_score") & (F.abs("raw_score") < float("inf")))
    ranked = finite.withColumn("rank", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("raw_score"), "id")))
    return ranked.filter(F.col("rank") <= per_lane) if per_lane else ranked


def evidence_key() -> Column:
    return (
        F.when((F.col("lane") == "historical") & F.col("observation_id").isNotNull(), F.concat(F.lit("observation:"), "observation_id"))
        .when(F.col("content_id").isNotNull(), F.concat(F.lit("content:"), "content_id"))
        .when(F.size("evidence_ids") > 0, F.concat(F.lit("evidence:"), F.array_join(F.array_sort("evidence_ids"), "|")))
        .otherwise(F.concat(F.lit("id:"), "id"))
    )


def fuse(candidates: DataFrame, limit: int = 5, boost: float = 0.0, lane_order: Sequence[str] = ()) -> DataFrame:
    """Reciprocal-rank fusion, one row for each piece of evidence, best first.

    Needs id, lane, raw_score, project_id, content_id, observation_id and evidence_ids.
    A row's share is 1 / (60 + rank), plus the boost where a project is set; the row of
    the first lane stands for an id. Of rows with the same evidence the best stays.
    """
    limit = min(MAX_RESULTS, max(1, int(limit)))
    lanes = F.array(*[F.lit(lane) for lane in lane_order]) if lane_order else None
    place = F.array_position(lanes, F.col("lane")) if lane_order else F.col("lane")
    share = 1.0 / (RRF_CONSTANT + F.col("rank")) + F.when(F.col("project_id").isNotNull(), F.lit(boost)).otherwise(0.0)
    ranked = rank_lanes(candidates).withColumns({"share": share, "place": place, "evidence_key": evidence_key()})
    fused = ranked.groupBy("id").agg(F.round(F.sum("share"), 9).alias("score"), F.min_by(F.struct("evidence_key", "lane", "project_id"), F.struct("place", "rank")).alias("first"))
    best = Window.partitionBy("first.evidence_key").orderBy(F.desc("score"), "id")
    kept = fused.withColumn("n", F.row_number().over(best)).filter("n = 1")
    return kept.select("id", "score", F.col("first.evidence_key").alias("evidence_key"), F.col("first.lane").alias("lane")).orderBy(F.desc("score"), "id").limit(limit)


def exact_text() -> Column:
    """What an exact search looks at, by record type; a conflict has nothing."""
    return (
        F.when(F.col("record_type") == "episode", F.concat_ws(" ", "text", "tool_name", "tool_args", "error_fingerprint"))
        .when(F.col("record_type") == "curated_memory", F.concat_ws(" ", "text", "subject", "predicate", "value"))
        .when((F.col("record_type") == "curated_current") & (F.col("resolution") == "resolved"), F.col("text"))
        .otherwise("")
    )


def exact_lane(records: DataFrame, query: str, limit: int, pages: int = 4, page_size: int = 256) -> DataFrame:
    """The exact lane: a bounded scan in id order, then the exact predicate, best by id.

    A record is scanned if its text holds a word of the query or its tool name or error
    fingerprint is a term; every scanned one must then hold all terms. Scores are 1.
    """
    terms = exact_terms(query)
    wide = F.coalesce(F.col("tool_name").isin(terms), F.lit(False)) | F.coalesce(F.col("error_fingerprint").isin(terms), F.lit(False)) if terms else F.lit(False)
    for term in terms:
        wide |= contains_terms(F.col("text"), [term])
    scanned = records.filter(wide).orderBy("id").limit(pages * page_size)
    return scanned.filter(contains_terms(exact_text(), terms)).orderBy("id").limit(limit).withColumn("raw_score", F.lit(1.0))


MAX_CANDIDATE_TEXT, MAX_EVIDENCE = 16_000, 1024


def candidates(records: DataFrame, others: Column | None = None) -> DataFrame:
    """Records as retrieval candidates; what no answer can rest on goes, but for ``others``.

    Needs record_type, resolution, text, tool_name, event_kind, score and evidence_ids.
    An episode is its own evidence and shows a safe text. Conflicts, blank and oversized
    texts, scores that are no number, and evidence that is missing, repeated or beyond
    1,024 ids drop the record.
    """
    episode = F.col("record_type") == "episode"
    safe = (
        F.when(F.trim("text") != "", F.col("text"))
        .when(F.col("tool_name").isNotNull(), F.concat(F.when(F.col("event_kind") == "tool_error", "Tool error: ").otherwise("Tool: "), "tool_name"))
        .otherwise(F.concat(F.lit("Memory event: "), "event_kind"))
    )
    shown = records.withColumns({"text": F.when(episode, safe).otherwise(F.col("text")), "evidence_ids": F.when(episode, F.array("id")).otherwise(F.col("evidence_ids"))})
    n = F.size(F.coalesce("evidence_ids", F.array().cast("array<string>")))
    keep = (
        ~((F.col("record_type") == "curated_current") & (F.coalesce("resolution", F.lit("")) != "resolved"))
        & (F.trim("text") != "")
        & (F.length("text") <= MAX_CANDIDATE_TEXT)
        & F.col("score").isNotNull()
        & ~F.isnan("score")
        & (F.abs("score") < float("inf"))
        & (n > 0)
        & (n <= MAX_EVIDENCE)
        & (F.size(F.array_distinct("evidence_ids")) == n)
    )
    keep = F.coalesce(keep, F.lit(False))
    return shown.filter(keep if others is None else others | keep)


def with_all_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates whose every evidence id resolves (relational division)."""
    links = candidates.select("id", F.explode("evidence_ids").alias("evidence_id"))
    known = evidence.select(F.col("id").alias("evidence_id")).distinct()
    missing = links.join(known, "evidence_id", "left_anti").select("id").distinct()
    return candidates.filter(F.size("evidence_ids") > 0).join(missing, "id", "left_anti")


def lookup(records: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """Records of several types by id, with ``n``, how many share an id; ``strict`` fails on an ambiguous one."""
    found = records.join(ids.select("id").distinct(), "id", "left_semi").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    if not strict:
        return found
    refused = F.raise_error(F.concat(F.lit("ambiguous id "), "id")).cast("long")
    return found.withColumn("n", F.when(F.col("n") > 1, refused).otherwise(F.col("n")))


def typed_scan(records: DataFrame, key: str = "id") -> DataFrame:
    """All rows; any key that is null or repeated fails the whole scan."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    refused = F.raise_error(F.lit("a scanned id is missing or repeated")).cast("boolean")
    return records.withColumn("_n", n).filter(F.when(F.col(key).isNull() | (F.col("_n") > 1), refused).otherwise(True)).drop("_n")


def bounded_lookup(records: DataFrame, ids: Sequence[str], key: str = "id", most: int = 1024) -> DataFrame:
    """Records by a bounded list of distinct ids; a longer or repeating list is refused."""
    if not ids or len(ids) > most or len(set(ids)) != len(ids):
        raise ValueError(f"1 to {most} distinct ids are looked up at a time")
    return records.filter(F.col(key).isin(list(ids)))


def strict_barrier(candidates: DataFrame, bad: DataFrame, answer: str | None = None) -> DataFrame:
    """All candidates, or none if ``bad`` has a row; with ``answer``, a column of both, for each answer by itself.

    Without it the flag is one row, whatever ``bad`` holds.
    """
    if answer is not None:
        return candidates.join(bad.select(answer).distinct(), answer, "left_anti")
    flag = bad.limit(1).agg((F.count(F.lit(1)) > 0).alias("_blocked"))
    return candidates.join(F.broadcast(flag), F.lit(True)).filter(~F.col("_blocked")).drop("_blocked")


def authorised(candidates: DataFrame, policies: DataFrame, now: int, skew: int, destinations: dict[str, str], residency: str, data_use: str, revoked: Sequence[str] = (), answer: str | None = None) -> DataFrame:
    """Candidates whose policy names exactly these destinations and labels, and has not lapsed.

    ``destinations`` has the ids by capability: store_id, embedding_id and llm_id. A
    policy that is missing for any candidate empties the whole answer; one that does not
    authorise drops its candidate. A revoked destination authorises nothing.
    """
    good = (F.col("residency") == residency) & (F.col("data_use") == data_use) & not_expired(now, skew, "policy_expires_at")
    for capability, wanted in destinations.items():
        good &= F.col(capability) == wanted
    if set(destinations.values()) & set(revoked):
        good = F.lit(False)
    own = policies.select(F.col("policy_id").alias("processing_policy_id"), F.col("expires_at").alias("policy_expires_at"), "residency", "data_use", *destinations).withColumn("_good", F.coalesce(good, F.lit(False)))
    held = candidates.join(own.select("processing_policy_id", "_good"), "processing_policy_id", "left")
    return strict_barrier(held, held.filter("_good IS NULL"), answer).filter("_good").drop("_good")


def effective(episodes: DataFrame, policy_id: str, expires_at: int, destination_id: str) -> DataFrame:
    """Episodes under a worker's policy: its id, destination and the earlier expiry; their own policy stays as the origin's."""
    return episodes.withColumns({"origin_policy": F.col("processing_policy_id"), "processing_policy_id": F.lit(policy_id), "expires_at": F.least(F.coalesce("expires_at", F.lit(expires_at)), F.lit(expires_at)), "destination_id": F.lit(destination_id)})


def token_estimate(text: Column, budget: int, tokens: Column | int = 1) -> Column:
    """Tokens that a member counts for: its own number, a quarter of its bytes and 32, and a 1,024th of the budget, whichever is most."""
    own = F.lit(tokens) if isinstance(tokens, int) else tokens
    return F.greatest(own, F.ceil(F.octet_length(text) / 4) + 32, F.lit(-(-budget // 1024)))


def pack(hits: DataFrame, budget: int, answer: str | None = None) -> DataFrame:
    """Ranked hits that fit a character budget; the first that does not fit is cut, the rest go.

    Needs ``position`` (1-based), ``text`` and ``suffix``; returns position and entry.
    The hits of one answer are at most ten, so one task orders them; ``answer`` is the
    column that tells answers apart, if there are several.
    """
    prefix = F.concat(F.lit("["), F.col("position"), F.lit("] "))
    full = F.concat(prefix, "text", "suffix")
    keys = [answer] if answer else []
    before = Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(budget) - F.coalesce(F.sum("size").over(before), F.lit(0))
    sized = hits.withColumns({"full": full, "size": F.length(full)}).withColumn("room", room)
    cut = F.col("room") - F.length(prefix) - F.length("suffix")
    entry = F.when(F.col("size") <= F.col("room"), F.col("full")).when(cut > 0, F.concat(prefix, F.expr("left(text, CAST(room - length(concat('[', position, '] ')) - length(suffix) - 1 AS INT))"), F.lit("…"), "suffix"))
    return sized.withColumn("entry", entry).filter("room > 0 AND entry IS NOT NULL").select(*keys, "position", "entry")
