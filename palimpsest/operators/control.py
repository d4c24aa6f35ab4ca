"""The collection's control row, destinations, identities and delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = "owner_host string, version long, active_generation string, policy_epoch long, privacy_epoch long, state string, revoked array<string>"


def bootstrap(spark: SparkSession, owners: list[str]) -> DataFrame:
    """Version 0 of the control row of each owner; it authorises nothing."""
    return spark.createDataFrame([(o, 0, None, 0, 0, "active", []) for o in sorted(set(owners))], CONTROL)


def _next(control: DataFrame, expected: Column, **changes: Column) -> DataFrame:
    """The next version where the expected one holds; other rows stay as they are."""
    hit = F.coalesce(expected, F.lit(False))
    moved = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()}
    return control.withColumns({**moved, "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))})


def drain(control: DataFrame, version: int) -> DataFrame:
    return _next(control, (F.col("version") == version) & (F.col("state") == "active"), state=F.lit("draining"))


def activate(control: DataFrame, version: int, pending: int) -> DataFrame:
    """A new policy epoch once nothing is pending."""
    return _next(control, (F.col("version") == version) & (F.col("state") == "draining") & F.lit(pending == 0), state=F.lit("active"), policy_epoch=F.col("policy_epoch") + 1)


def forget_barrier(control: DataFrame, version: int) -> DataFrame:
    """A new privacy epoch; the published generation no longer shows."""
    return _next(control, F.col("version") == version, privacy_epoch=F.col("privacy_epoch") + 1, active_generation=F.lit(None).cast("string"))


def revoke(control: DataFrame, version: int, destinations: list[str]) -> DataFrame:
    """Revocations only grow, and each opens a policy epoch."""
    union = F.array_sort(F.array_union("revoked", F.array(*map(F.lit, destinations))))
    return _next(control, F.col("version") == version, revoked=union, policy_epoch=F.col("policy_epoch") + 1)


def publish(control: DataFrame, version: int, base: str | None, generation: str) -> DataFrame:
    """Compare and set the generation: the version and the base must be those that were read."""
    return _next(control, (F.col("version") == version) & F.col("active_generation").eqNullSafe(F.lit(base)), active_generation=F.lit(generation))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Owners whose control row is the same in two snapshots."""
    return before.intersect(after).select("owner_host")


def canonical_origin(url: Column) -> Column:
    """A repository's origin without scheme, credentials, port and suffix, lower-case host."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^[^/@]*@", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^([^/:]+):(?:\d+/)?/*", "$1/"), r"(\.git)?/*$", "")
    return F.concat(F.lower(F.split_part(path, F.lit("/"), F.lit(1))), F.regexp_replace(path, r"^[^/]*", ""))


def origin_fingerprint(url: Column) -> Column:
    return F.substring(F.sha2(canonical_origin(url), 256), 1, 32)


def local_project(path: Column, salt: str) -> Column:
    """An id of an unregistered project that does not tell its path."""
    return F.concat(F.lit("local:"), F.substring(F.sha2(F.concat(F.lit(salt), F.lit("|"), path), 256), 1, 32))


def identify(rows: DataFrame, registry: DataFrame, salt: str) -> DataFrame:
    """Rows with the fingerprint of their ``url``, whether it is registered, and their project's id.

    ``registry`` has fingerprint and project; of several projects of a fingerprint the smallest counts.
    """
    known = registry.groupBy("fingerprint").agg(F.min("project").alias("_project"))
    named = rows.withColumn("fingerprint", origin_fingerprint(F.col("url"))).join(known, "fingerprint", "left")
    return named.withColumns({"identity_kind": F.when(F.col("_project").isNotNull(), "registered").otherwise("local_only"), "project_id": F.coalesce("_project", local_project(F.col("url"), salt))}).drop("_project")


def canonical_endpoint(url: Column) -> Column:
    """An endpoint without slashes at its end; null for other schemes, credentials, queries and fragments."""
    plain = F.when(url.rlike(r"^https?://[^/?#@]+(/[^?#]*)?$"), F.regexp_replace(url, r"/+$", ""))
    return F.when(url.startswith("unix:"), url).otherwise(plain)


def local_destination(url: Column, node: str, residency: str, data_use: str) -> Column:
    """The id of a destination on this machine: a hash of endpoint, node and labels; null for any other."""
    endpoint = canonical_endpoint(url)
    loopback = endpoint.startswith("unix:") | endpoint.rlike(r"^https?://(127\.0\.0\.1|localhost|\[::1\])(:[0-9]+)?(/|$)")
    body = F.concat(F.lit(f'{{"dataUse":"{data_use}","endpoint":"'), endpoint, F.lit(f'","nodeId":"{node}","residency":"{residency}"}}'))
    return F.when(loopback, F.concat(F.lit("local:"), F.substring(F.sha2(body, 256), 1, 32)))


ENVELOPE = "host string, policy_id string, policy_epoch long, prompt_revision string, items array<string>"


def envelope(payload: Column) -> Column:
    """A proposal's envelope as a struct; one that is malformed or lacks a field is null throughout."""
    read = F.from_json(payload, ENVELOPE, {"mode": "PERMISSIVE"})
    whole = read["items"].isNotNull() & read["host"].isNotNull() & read["policy_id"].isNotNull() & read["policy_epoch"].isNotNull() & read["prompt_revision"].isNotNull()
    return F.when(whole, read)


def provenance_matches(envelope: Column, expected: Column) -> Column:
    """Whether an envelope was made for exactly this host, policy, epoch and prompt."""
    out = F.lit(True)
    for name in ("host", "policy_id", "policy_epoch", "prompt_revision"):
        out &= envelope[name] == expected[name]
    return F.coalesce(out, F.lit(False))


def to_payload(records: DataFrame) -> DataFrame:
    """Wire form: snake_case names, nulls left out, defaults filled in."""
    import re

    snake = [F.col(c).alias(re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), c)) for c in records.columns]
    named = records.select(*snake)
    for column, default in (("status", "active"), ("secret_scan", "passed")):
        named = named.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in named.columns else F.lit(default))
    return named.select("id", F.to_json(F.struct(*[c for c in sorted(named.columns) if c != "id"])).alias("payload"))


def from_payload(wire: DataFrame, fields: str) -> DataFrame:
    """Records from wire form: (id, payload) to the named fields, given as camelCase columns of a schema."""
    import re

    snake = re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), fields)
    names = [f.split()[0] for f in fields.split(", ")]
    read = wire.select("id", F.from_json("payload", snake).alias("p"))
    return read.select("id", *[F.col("p." + re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), n)).alias(n) for n in names])


def hash_embedding(text: Column, dimensions: int = 4) -> Column:
    """A unit vector that the text's hash fixes: a stand-in for an embedding service."""
    digest = F.sha2(text, 256)
    raw = F.array(*[F.conv(F.substring(digest, 8 * i % 57 + 1, 8), 16, 10).cast("double") / 2**31 - 1.0 for i in range(dimensions)])
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def deliver(jobs: DataFrame, now: int, skew: int, base: int, most: int) -> DataFrame:
    """What one delivery pass makes of each job, with its retry state after it.

    Needs job_id, attempts, deadline, next_at and result (done, failed or refused by the
    processor). An expired job is quarantined before it is tried; one whose time has not
    come is pending; a failure waits, longer each time and by a jitter that its id fixes.
    """
    from palimpsest.operators.coordination import retry_delay

    outcome = F.when(F.col("deadline") <= now + skew, "quarantined").when(F.col("next_at") > now, "pending").when(F.col("result") == "failed", "retry").when(F.col("result") == "refused", "quarantined").otherwise("delivered")
    judged = jobs.withColumn("outcome", outcome)
    again = F.col("outcome") == "retry"
    tried = judged.withColumn("attempts", F.when(again, F.col("attempts") + 1).otherwise(F.col("attempts")))
    return tried.withColumn("next_at", F.when(again, F.lit(now) + retry_delay(F.col("job_id").cast("string"), F.col("attempts"), base, most)).otherwise(F.col("next_at")))
