"""Memory search for many requests at once: gates, lanes, descent, fusion and barriers.

A request is a row, so one scan of the records serves all requests of a batch, and every
rule that empties an answer empties that request's alone. Ranks, fusion and barriers hold
at most a few hundred rows for each request. The lanes' rows are written to the shared
folder, all after them is one lazy plan, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import normalize_nfkc
from palimpsest.operators import retrieval as op
from palimpsest.sources.shared import written

MODES = {
    "all": ["current", "historical", "episodes", "curated", "raptor"],
    "curated": ["current", "historical"],
    "current": ["current"],
    "historical": ["historical"],
    "episodes": ["episodes"],
    "raptor": ["raptor"],
}
LANES = ["exact", "current", "historical", "episodes", "curated", "raptor"]
#: Modes with an exact lane, and the record types that it has there.
EXACT_TYPES = {"all": ["episode", "curated_memory", "curated_current"], "curated": ["curated_memory", "curated_current"], "episodes": ["episode"]}
MAX_QUERY, MAX_ID = 4000, 512
#: Descent below a summary: levels, records of a level, records in all.
MAX_DEPTH, MAX_LEVEL, MAX_VISITED = 10, 1024, 8192

REQUEST_SCHEMA = "request_id string, query string, project_id string, project_kind string, mode string, is_child boolean, k int, after long, before long, terms array<string>"
#: What an answer needs to know of its request.
ANSWERED = ["request_id", "project_id", "mode", "k", "everywhere", "has_vector"]
HIT_COLUMNS = ["request_id", "position", "id", "record_type", "lane", "score", "text", "valid_from", "valid_to"]


@dataclass(frozen=True)
class SearchConfig:
    """What is the same for all requests of a host."""

    owner: str
    now: int
    skew: int = 300_000
    per_lane: int = 20
    least_score: float = 0.35
    boost: float = 0.05
    root_global: bool = True
    child_search: bool = False
    store_id: str = "store"
    embedding_id: str = "embedding"
    llm_id: str = "llm"
    residency: str = "eu"
    data_use: str = "memory"


@dataclass(frozen=True)
class Store:
    """The frames that a search reads.

    ``records`` has one row a record with id, record_type, owner_host, project_id,
    project_kind, scope, status, secret_scan, privacy_epoch, policy_epoch, policy_hash,
    processing_policy_id, expires_at, created_at, happened_at (of an event, an effect or the end of
    a summary's range), text, tool_name, tool_args, error_fingerprint, event_kind, subject,
    predicate, value, resolution, content_id, observation_id, state_key, evidence_ids,
    member_ids, covered_projects, generation_id and vector. ``control`` has one row:
    owner_host, version, state, privacy_epoch, policy_epoch, policy_hash,
    active_generation, processing_policy_id and revoked. ``control_after`` is the same
    read again; a difference empties every answer.
    """

    records: DataFrame
    policies: DataFrame
    tombstones: DataFrame
    control: DataFrame
    control_after: DataFrame | None = None


class RequestRow:
    """A SQL table function's row: a request in its checked form."""

    def eval(self, request_id: str, query: str, mode: str, project_id: str, project_kind: str, k: int) -> Iterator[tuple]:
        clean = (query or "").strip()
        yield request_id, clean, project_id, project_kind, mode, False, k, None, None, op.exact_terms(clean)


def with_terms(requests: DataFrame) -> DataFrame:
    """Requests with their trimmed query and its exact terms."""

    @F.pandas_udf("array<string>")
    def terms(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: op.exact_terms(q or ""))

    clean = requests.withColumn("query", F.trim(F.coalesce("query", F.lit(""))))
    return clean.withColumn("terms", terms("query"))


def _snapshot(control: DataFrame) -> DataFrame:
    """The control record as one struct; no row unless there is exactly one."""
    names = ["owner_host", "version", "state", "privacy_epoch", "policy_epoch", "policy_hash", "active_generation", "processing_policy_id", "revoked"]
    return control.groupBy().agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*names)).alias("c")).filter("n = 1").select("c")


def gated(requests: DataFrame, control: DataFrame, config: SearchConfig) -> DataFrame:
    """(q, c): requests that may be answered, with the control record that they are answered under."""
    fine = (
        F.length("query").between(1, MAX_QUERY)
        & F.coalesce(F.length("project_id").between(1, MAX_ID), F.lit(False))
        & F.coalesce(F.col("project_kind").isin("registered", "local_only"), F.lit(False))
        & F.col("mode").isin(*MODES)
        & (F.coalesce("before", F.lit(2**62)) >= F.coalesce("after", F.lit(-(2**62))))
    )
    if not config.child_search:
        fine &= ~F.coalesce("is_child", F.lit(False))
    everywhere = (F.lit(config.root_global) & ~F.coalesce("is_child", F.lit(False)) & (F.col("project_kind") == "registered")).alias("everywhere")
    own = requests.filter(fine).select(F.struct("*", everywhere, F.col("vector").isNotNull().alias("has_vector")).alias("q"))
    # a control record of version 0 was never activated and authorises nothing
    ready = (F.col("c.owner_host") == config.owner) & (F.col("c.state") == "active") & (F.col("c.version") > 0)
    for destination in (config.store_id, config.llm_id):
        ready &= ~F.array_contains("c.revoked", destination)
    return own.join(F.broadcast(_snapshot(control).filter(ready)), F.lit(True))


def _authorises(config: SearchConfig, with_embedding: Column) -> Column:
    """Whether the joined policy ``p`` lets records go to this search's destinations."""
    good = (
        (F.col("p.owner_host") == config.owner)
        & (F.col("p.privacy_epoch") == F.col("c.privacy_epoch"))
        & (F.col("p.store_id") == config.store_id)
        & (F.col("p.llm_id") == config.llm_id)
        & (F.col("p.residency") == config.residency)
        & (F.col("p.data_use") == config.data_use)
        & op.not_expired(config.now, config.skew, "p.expires_at")
    )
    embedding = (F.col("p.embedding_id") == config.embedding_id) & ~F.array_contains("c.revoked", config.embedding_id)
    return F.coalesce(good & (~with_embedding | embedding), F.lit(False))


def _policies(policies: DataFrame) -> DataFrame:
    """(policy_id, p): policies that one record states; a repeated id is as good as none."""
    names = ["owner_host", "privacy_epoch", "store_id", "embedding_id", "llm_id", "residency", "data_use", "expires_at"]
    return policies.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*names)).alias("p")).filter("n = 1").select("policy_id", "p")


def _probes(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What requests ask of the records, each once, and (probe, p_lane, q, c): the requests' shares in it.

    Modes, projects and identities of a batch ask much alike. A probe has a reach and key,
    a window, a vector for its dense lanes or terms and types for its exact one.
    """
    keys = [F.struct(F.lit(reach).alias("reach"), F.col("q.project_id").alias("key")) for reach in ("project", "covers")]
    all_records = F.when(F.col("q.everywhere"), F.struct(F.lit("global").alias("reach"), F.lit("").alias("key")))
    lanes = F.create_map(*[x for m, found in MODES.items() for x in (F.lit(m), F.array(*map(F.lit, found)))])
    types = F.create_map(*[x for m, found in EXACT_TYPES.items() for x in (F.lit(m), F.array(*map(F.lit, found)))])
    nothing = F.lit(None).cast("array<string>")
    # without a vector there is no dense lane, without terms or types no exact one
    dense = F.when(F.col("q.vector").isNotNull(), F.transform(F.element_at(lanes, F.col("q.mode")), lambda lane: F.struct(lane.alias("p_lane"), nothing.alias("p_types"))))
    exact = F.when(F.col("reach").isin("project", "global") & (F.size("q.terms") > 0) & F.element_at(types, F.col("q.mode")).isNotNull(), F.array(F.struct(F.lit("exact").alias("p_lane"), F.element_at(types, F.col("q.mode")).alias("p_types"))))
    none = F.array().cast("array<struct<p_lane:string,p_types:array<string>>>")
    each = asked.select("q", "c", F.inline(F.array_compact(F.array(*keys, all_records)))).select("*", F.inline(F.concat(F.coalesce(dense, none), F.coalesce(exact, none))))
    is_exact = F.col("p_lane") == "exact"
    parts = {"p_after": F.col("q.after"), "p_before": F.col("q.before"), "p_terms": F.when(is_exact, F.col("q.terms")), "p_vector": F.when(~is_exact, F.col("q.vector"))}
    named = ["reach", "key", "p_types", *parts]
    told = each.withColumns(parts).withColumn("probe", F.sha2(F.to_json(F.struct(*named)), 256))
    probes = told.groupBy("probe").agg(*(F.first(n).alias(n) for n in (*named, "c")), F.collect_set("p_lane").alias("p_lanes"))
    return probes, told.select("probe", "p_lane", F.struct(*[F.col(f"q.{n}").alias(n) for n in ANSWERED]).alias("q"), "c")


def _lanes_of() -> Column:
    """The lanes of a record for a probe, as an array of structs."""
    kind = F.col("record_type")

    def in_window(time: str) -> Column:
        return (F.col("p_after").isNull() | (F.col(time) >= F.col("p_after"))) & (F.col("p_before").isNull() | (F.col(time) <= F.col("p_before")))

    policy = F.col("policy_epoch") == F.col("c.policy_epoch")
    scoped = ((F.col("reach") == "project") & (F.col("scope") == "project")) | ((F.col("reach") == "global") & (F.col("scope") == "global"))
    wide = F.exists(F.col("p_terms"), lambda t: F.coalesce(F.col("folded").contains(t), F.lit(False)) | F.coalesce(F.col("tool_name") == t, F.lit(False)) | F.coalesce(F.col("error_fingerprint") == t, F.lit(False)))
    conditions = {
        "exact": F.array_contains("p_types", kind) & F.col("reach").isin("project", "global") & in_window("created_at") & wide & F.col("holds"),
        "current": (kind == "curated_current") & policy & scoped & in_window("created_at"),
        "historical": (kind == "curated_memory") & policy & scoped & in_window("happened_at"),
        "episodes": (kind == "episode") & (F.col("reach") == "project") & in_window("happened_at"),
        "curated": kind.isin("curated_memory", "curated_current") & policy & scoped & in_window("created_at"),
        "raptor": (kind == "raptor_summary") & policy & (F.col("reach") == "covers") & (F.col("generation_id") == F.col("c.active_generation")) & in_window("happened_at"),
    }
    entries = []
    for place, (lane, keep) in enumerate(conditions.items()):
        asked = F.array_contains("p_lanes", F.lit(lane)) & keep
        if lane != "exact":
            asked &= F.col("dense").isNotNull()
        score = F.lit(1.0) if lane == "exact" else F.col("dense")
        entries.append(F.when(F.coalesce(asked, F.lit(False)), F.struct(F.lit(lane).alias("lane"), F.lit(place).alias("place"), score.alias("score"))))
    return F.array_compact(F.array(*entries))


def lane_hits(records: DataFrame, asked: DataFrame, config: SearchConfig) -> DataFrame:
    """What each lane of each request returns, before anything is judged: q, c, lane, place, score and the record.

    Records meet probes on their scope: a project, all projects, or a project that a
    summary covers; requests that ask the same share a probe. Every record that its scope
    and terms let in is ranked; ranks are cut in each task before rows are dealt by probe
    and lane, for which Spark's threshold of such cuts is raised to a lane's rows.
    """
    cut = "spark.sql.optimizer.windowGroupLimitThreshold"
    records.sparkSession.conf.set(cut, str(max(int(records.sparkSession.conf.get(cut)), config.per_lane)))
    guarded = records.filter((F.col("owner_host") == config.owner) & (F.col("status") == "active") & (F.col("secret_scan") == "passed") & op.not_expired(config.now, config.skew))
    reaches = F.array_compact(
        F.array(
            F.when(F.col("project_id").isNotNull() & (F.col("record_type") != "raptor_summary"), F.struct(F.lit("project").alias("reach"), F.col("project_id").alias("key"))),
            F.when(F.col("scope") == "global", F.struct(F.lit("global").alias("reach"), F.lit("").alias("key"))),
        )
    )
    covers = F.transform(F.coalesce("covered_projects", F.array().cast("array<string>")), lambda p: F.struct(F.lit("covers").alias("reach"), p.alias("key")))
    # folded once a record, below the join: a lambda cannot call Python
    folded = guarded.withColumns({"folded": F.lower(normalize_nfkc(F.col("text"))), "folded_whole": F.lower(normalize_nfkc(op.exact_text()))})
    spread = folded.select("*", F.inline(F.concat(reaches, covers)))
    probes, shares = _probes(asked)
    met = spread.join(F.broadcast(probes), ["reach", "key"]).filter(F.col("privacy_epoch") == F.col("c.privacy_epoch"))
    product = F.aggregate(F.zip_with(F.col("vector").cast("array<double>"), F.col("p_vector"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = met.withColumn("dense", F.round(product, 6)).withColumn("dense", F.when(~F.isnan("dense") & (F.abs("dense") < float("inf")), F.col("dense")))
    holds = F.coalesce(F.forall(F.col("p_terms"), lambda t: F.col("folded_whole").contains(t)), F.lit(False))
    listed = scored.withColumn("holds", holds).select("*", F.inline(_lanes_of())).drop("vector", "dense", "holds", "folded", "folded_whole", "p_vector", "p_terms", "p_types", "p_lanes", "p_after", "p_before", "c")
    order = Window.partitionBy("probe", "lane").orderBy(F.desc("score"), "id")
    # a score below the least ranks behind all that are not, so it can go before ranks are given
    may = listed.filter((F.col("lane") == "exact") | (F.col("score") >= config.least_score))
    both = may.withColumn("seen", F.row_number().over(order)).filter(F.col("seen") <= config.per_lane).drop("seen")
    return both.join(F.broadcast(shares.withColumnRenamed("p_lane", "lane")), ["probe", "lane"]).drop("probe")


def descend(seeds: DataFrame, records: DataFrame, config: SearchConfig) -> DataFrame:
    """The records below summaries, with q, c and ``fails``; a failing one empties its request.

    ``seeds`` has q, c, score, processing_policy_id and member_ids. A leaf carries the best
    score and all policies of the ways to it. A missing, repeated, expired or stale
    record, one of another owner, and a level or a whole beyond its bound fail. A cycle is
    a descent without end, and fails too.
    """
    start = seeds.select("q", "c", "score", F.array("processing_policy_id").alias("policies"), F.explode("member_ids").alias("id"))
    edges = records.filter("record_type = 'raptor_summary'").select("id", F.col("processing_policy_id").alias("policy"), F.explode("member_ids").alias("member"))
    reached = records.sparkSession.sql(
        f"""WITH RECURSIVE below AS (
          SELECT q, c, id, score, policies, 1 AS depth FROM {{start}}
          UNION ALL
          SELECT b.q, b.c, e.member, b.score, array_union(b.policies, array(e.policy)), b.depth + 1
          FROM below b JOIN {{edges}} e ON b.id = e.id WHERE b.depth <= {MAX_DEPTH})
        SELECT q.request_id AS asked, id, first(q) AS q, first(c) AS c, max(score) AS score, array_sort(array_distinct(flatten(collect_list(policies)))) AS ways, min(depth) AS depth, max(depth) AS last
        FROM below GROUP BY q.request_id, id""",
        start=start,
        edges=edges,
    )
    sized = reached.withColumns({"level": F.count(F.lit(1)).over(Window.partitionBy("asked", "depth")), "visited": F.count(F.lit(1)).over(Window.partitionBy("asked"))})
    found = sized.join(records.drop("vector"), "id", "left")
    copies = F.count(F.lit(1)).over(Window.partitionBy("asked", "id"))
    summary = F.col("record_type") == "raptor_summary"
    current = (F.col("policy_epoch") == F.col("c.policy_epoch")) & (F.col("policy_hash") == F.col("c.policy_hash"))
    fine = (
        (F.col("owner_host") == config.owner)
        & (F.col("privacy_epoch") == F.col("c.privacy_epoch"))
        & op.not_expired(config.now, config.skew)
        & F.when(summary, (F.col("generation_id") == F.col("c.active_generation")) & current & F.size("member_ids").between(1, MAX_LEVEL) & F.array_contains("covered_projects", F.col("q.project_id")))
        .when(F.col("record_type") == "episode", (F.col("project_id") == F.col("q.project_id")) & (F.col("status") == "active") & (F.col("secret_scan") == "passed"))
        .when(F.col("record_type").isin("curated_memory", "curated_current"), current)
        .otherwise(False)
    )
    bounded = (F.col("level") <= MAX_LEVEL) & (F.col("visited") <= MAX_VISITED) & (F.col("last") <= MAX_DEPTH)
    return found.withColumn("fails", ~F.coalesce(fine & bounded & (copies == 1), F.lit(False))).filter(F.col("fails") | ~summary).drop("asked", "depth", "last", "level", "visited")


def _candidates(hits: DataFrame, others: Column) -> DataFrame:
    """Hits that can be part of an answer, in scope and under the current policy; ``others`` stay as they are."""
    shown = op.candidates(hits, others)
    current = (F.col("record_type") == "episode") | ((F.col("policy_epoch") == F.col("c.policy_epoch")) & (F.col("policy_hash") == F.col("c.policy_hash")))
    scope = F.when(F.col("record_type") == "episode", "project").otherwise(F.col("scope"))
    in_scope = ((scope == "project") & (F.col("project_id") == F.col("q.project_id"))) | ((scope == "global") & F.col("q.everywhere"))
    # the exact lane does not look at the policy's epoch
    return shown.withColumn("scope", scope).filter(others | (F.coalesce(in_scope, F.lit(False)) & F.coalesce((F.col("lane") == "exact") | current, F.lit(False))))


def _embeddable(hits: DataFrame, policies: DataFrame, config: SearchConfig) -> DataFrame:
    """Hits without the dense ones of requests whose query must not be embedded, and ``dense_used``.

    The control record's policy and those of all exact hits must let it.
    """
    known = _policies(policies)
    own = hits.join(known.withColumnRenamed("policy_id", "processing_policy_id"), "processing_policy_id", "left").withColumn("_own", _authorises(config, F.lit(True))).drop("p")
    both = own.join(known.select(F.col("policy_id").alias("_control_policy"), "p"), F.col("c.processing_policy_id") == F.col("_control_policy"), "left").withColumn("_control", _authorises(config, F.lit(True)))
    may = F.min(F.col("_control") & ((F.col("lane") != "exact") | F.col("_own"))).over(Window.partitionBy("q.request_id"))
    judged = both.withColumn("_may", may).filter((F.col("lane") == "exact") | F.col("_may"))
    return judged.withColumn("dense_used", F.col("_may") & F.col("q.has_vector")).drop("p", "_own", "_control", "_control_policy", "_may")


def _intervals(candidates: DataFrame) -> DataFrame:
    """The historical lane as intervals: of adjacent equal contents the first, closed by the next."""
    stream = Window.partitionBy("q.request_id", "lane", "policy_epoch", "state_key", "scope", "project_id").orderBy("happened_at", "id")
    past = F.col("lane") == "historical"
    whole = F.col("state_key").isNotNull() & F.col("content_id").isNotNull() & F.col("happened_at").isNotNull() & F.col("policy_epoch").isNotNull()
    changed = candidates.withColumn("prior", F.lag("content_id").over(stream)).filter(~past | (whole & (F.col("prior").isNull() | (F.col("prior") != F.col("content_id")))))
    return changed.withColumns({"valid_from": F.when(F.col("record_type") == "curated_memory", F.col("happened_at")), "valid_to": F.when(past, F.lead("happened_at").over(stream))}).drop("prior")


def _fused(candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """(request_id, id, r): reciprocal ranks summed by id, the best of each piece of evidence, the first k of a request.

    ``r`` holds the hit of the first lane with its fused score.
    """
    ranks = Window.partitionBy("q.request_id", "lane").orderBy(F.desc("score"), "id")
    share = 1.0 / (op.RRF_CONSTANT + F.row_number().over(ranks)) + F.when(F.col("project_id").isNotNull(), F.lit(config.boost)).otherwise(0.0)
    names = [c for c in candidates.columns if c not in ("id", "score")]
    shares = candidates.withColumns({"share": share, "evidence_key": op.evidence_key()})
    summed = shares.groupBy(F.col("q.request_id").alias("request_id"), "id").agg(F.round(F.sum("share"), 9).alias("score"), F.min_by(F.struct(*names, "evidence_key"), F.struct("place", F.negative("score"))).alias("r"))
    best = summed.withColumn("n", F.row_number().over(Window.partitionBy("request_id", "r.evidence_key").orderBy(F.desc("score"), "id"))).filter("n = 1")
    placed = best.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "id")))
    k = F.greatest(F.lit(1), F.least(F.lit(op.MAX_RESULTS), F.coalesce("r.q.k", F.lit(5))))
    return placed.filter(F.col("position") <= k).select("request_id", "id", F.struct("r.*", "score").alias("r"))


def _each(hits: DataFrame, what: Column, name: str, other: DataFrame) -> DataFrame:
    """Hits joined with ``other`` on each element of an array; one without elements or matches stays, once."""
    return hits.withColumn(name, F.explode_outer(what)).join(other, name, "left")


def _evidenced(fused: DataFrame, records: DataFrame, config: SearchConfig) -> DataFrame:
    """Hits with ``alive`` (all their evidence is there) and their evidence's policies; bad evidence empties a request."""
    derived = F.col("r.record_type") != "episode"
    episodes = records.filter("record_type = 'episode'").select(
        F.col("id").alias("evidence_id"), F.struct("owner_host", "project_id", "project_kind", "privacy_epoch", "status", "secret_scan", "expires_at", "processing_policy_id").alias("e")
    )
    fine = (
        (F.col("e.owner_host") == config.owner)
        & (F.col("e.privacy_epoch") == F.col("r.c.privacy_epoch"))
        & (F.col("e.status") == "active")
        & (F.col("e.secret_scan") == "passed")
        & op.not_expired(config.now, config.skew, "e.expires_at")
        & F.when(F.col("r.scope") == "global", F.col("e.project_kind") == "registered").otherwise(F.col("e.project_id") == F.col("r.q.project_id"))
    )
    there = F.col("e").isNotNull()
    told = (
        _each(fused, F.when(derived, F.col("r.evidence_ids")), "evidence_id", episodes)
        .groupBy("request_id", "id")
        .agg(
            F.first("r").alias("r"),
            F.count_if(there).alias("n_found"),
            F.count_distinct(F.when(there, F.col("evidence_id"))).alias("n_known"),
            F.max(there & ~F.coalesce(fine, F.lit(False))).alias("bad"),
            F.collect_set("e.processing_policy_id").alias("evidence_policies"),
        )
    )
    refused = F.max(F.col("bad") | (F.col("n_found") > F.col("n_known"))).over(Window.partitionBy("request_id"))
    alive = ~derived | (F.col("n_known") == F.size("r.evidence_ids"))
    return told.withColumns({"refused": refused, "alive": alive}).filter(~F.col("refused")).select("request_id", "id", "r", "alive", "evidence_policies")


def _authorised(hits: DataFrame, policies: DataFrame, config: SearchConfig) -> DataFrame:
    """Hits all of whose policies authorise the destinations; a policy that is missing empties a request."""
    none = F.array().cast("array<string>")
    own = F.when(F.col("alive"), F.array_union(F.array("r.processing_policy_id"), F.coalesce("r.ways", none))).otherwise(none)
    each = _each(hits, F.array_union(own, F.col("evidence_policies")), "policy_id", _policies(policies)).withColumn("c", F.col("r.c"))
    allowed = F.min(_authorises(config, F.col("r.dense_used")))
    told = each.groupBy("request_id", "id").agg(F.first("r").alias("r"), F.first("alive").alias("alive"), F.max(F.col("policy_id").isNotNull() & F.col("p").isNull()).alias("unknown"), allowed.alias("allowed"))
    unknown = F.max("unknown").over(Window.partitionBy("request_id"))
    return told.withColumn("unknown", unknown).filter(~F.col("unknown") & F.col("alive") & F.col("allowed") & op.not_expired(config.now, config.skew, "r.expires_at")).select("request_id", "id", "r")


def _unburied(hits: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Hits of requests none of whose hits, evidence, contents or states was forgotten."""
    targets = F.array_distinct(F.array_compact(F.concat(F.array("id", "r.content_id", "r.observation_id", "r.state_key"), "r.evidence_ids")))
    buried = tombstones.select("target_id").distinct().withColumn("gone", F.lit(True))
    told = _each(hits, targets, "target_id", buried).groupBy("request_id", "id").agg(F.first("r").alias("r"), F.max(F.coalesce("gone", F.lit(False))).alias("gone"))
    return told.withColumn("gone", F.max("gone").over(Window.partitionBy("request_id"))).filter(~F.col("gone")).select("id", "r.*")


def search(store: Store, requests: DataFrame, config: SearchConfig) -> DataFrame:
    """Hits of every request: request_id, position, id, record_type, lane, score, text, valid_from, valid_to.

    ``requests`` has the columns of REQUEST_SCHEMA and ``vector``, the embedded query;
    without one, or where no policy lets the query go to the embedding, only the exact
    lane answers. A request that is refused, in whole or by one of the barriers, has no
    hits. Positions follow the score, in mode historical the time. The barriers are
    aggregates over each request's few hits, so the records are read once for the lanes,
    once for descents and once for evidence.
    """
    asked = gated(requests, store.control, config)
    raptor = F.col("lane") == "raptor"
    # read by several branches below: written once, it holds at most two times a lane's few rows for each lane
    found = written(lane_hits(store.records, asked, config), "lane-hits")
    hits = _embeddable(_candidates(found, raptor), store.policies, config).drop("reach", "key")
    whole = (F.col("policy_hash") == F.col("c.policy_hash")) & (F.col("covered_projects") == F.array("q.project_id")) & F.size("member_ids").between(1, MAX_LEVEL)
    seeds = hits.filter(raptor).filter(F.coalesce(whole, F.lit(False)))
    below = descend(seeds, store.records, config).withColumns({"lane": F.lit("raptor"), "place": F.lit(LANES.index("raptor")), "dense_used": F.lit(True)})
    every = hits.filter(~raptor).withColumns({"ways": F.lit(None).cast("array<string>"), "fails": F.lit(False)}).unionByName(_candidates(below, F.col("fails")))
    sound = every.withColumn("fails", F.max("fails").over(Window.partitionBy("q.request_id"))).filter(~F.col("fails"))
    kept = _unburied(_authorised(_evidenced(_fused(_intervals(sound), config), store.records, config), store.policies, config), store.tombstones)
    after = _snapshot(store.control_after or store.control).withColumnRenamed("c", "c_after")
    steady = kept.join(F.broadcast(after), F.lit(True)).filter(F.col("c") == F.col("c_after")).withColumn("request_id", F.col("q.request_id"))
    order = [F.when(F.col("q.mode") == "historical", F.coalesce("valid_from", F.lit(-(2**62)))).asc_nulls_last(), F.when(F.col("q.mode") != "historical", F.col("score")).desc_nulls_last(), F.col("id")]
    return steady.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)).cast("long")).select(*HIT_COLUMNS)


def register_sql(spark: SparkSession, store: Store, config: SearchConfig, embed: Callable[[DataFrame], DataFrame]) -> None:
    """Make search part of SQL.

    ``memory_request(id, query, mode, project, kind, k)`` is a table function of one
    checked request; put requests in a view ``memory_requests``, embedded by ``embed``,
    which adds ``vector``. Then ``memory_search(id)`` is a table function of a request's
    hits, whose plan the optimizer sees whole.
    """
    spark.udtf.register("memory_request", F.udtf(RequestRow, returnType=REQUEST_SCHEMA))
    search(store, embed(spark.table("memory_requests")), config).createOrReplaceTempView("memory_answers")
    columns = "request_id STRING, position BIGINT, id STRING, record_type STRING, lane STRING, score DOUBLE, text STRING, valid_from BIGINT, valid_to BIGINT"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION memory_search(wanted STRING) RETURNS TABLE ({columns}) RETURN SELECT {', '.join(HIT_COLUMNS)} FROM memory_answers WHERE request_id = wanted")
