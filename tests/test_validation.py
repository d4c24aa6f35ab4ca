"""Each record type: a whole record is valid, and each change breaks the rule that it should."""

import hashlib
import json

import pytest

from palimpsest.operators import validation as va

BASE = {"id": "r1", "owner_host": "alpha", "schema_revision": 1, "created_at": 1_700_000_000_000, "privacy_epoch": 1, "processing_policy_id": "pol1", "expires_at": None, "content_hash": "h"}
DERIVED = {"coordination_policy_hash": "ch", "coordination_policy_epoch": 2}
DIGEST = hashlib.sha256(json.dumps(["a", "b"], separators=(",", ":")).encode()).hexdigest()
TYPES = {"schema_revision": "int", "created_at": "long", "privacy_epoch": "long", "expires_at": "long", "coordination_policy_epoch": "long", "policy_epoch": "long", "fencing_token": "long", "version": "long", "level": "long", "seed": "long", "embedding_dimension": "int", "temporal_from": "long", "temporal_to": "long", "last_forget_barrier": "long", "policy_expires_at": "long"}
LISTS = ("membership", "members", "member_ids", "revoked_destination_ids", "source_episode_ids", "covered_projects")
ENVELOPE = [({"id": "my-password"}, "id"), ({"owner_host": None}, "owner"), ({"schema_revision": 2}, "revision"), ({"created_at": -1}, "created"), ({"privacy_epoch": 2**32}, "epoch"), ({"processing_policy_id": ""}, "policy"), ({"expires_at": -1}, "expiry"), ({"content_hash": "x" * 513}, "hash")]
POLICY = [({"coordination_policy_hash": None}, "coordination hash"), ({"coordination_policy_epoch": -1}, "coordination epoch")]
CASES = {
    "job": (DERIVED | {"policy_id": "pol1", "policy_hash": "ch", "policy_epoch": 2, "membership": ["a", "b"], "extractor_revision": "x1"}, POLICY + [({"policy_id": "pol2"}, "job policy"), ({"policy_hash": "other"}, "policy hash"), ({"policy_epoch": 3}, "policy epoch"), ({"membership": ["b", "a"]}, "membership"), ({"membership": ["a", "a"]}, "membership"), ({"membership": []}, "membership"), ({"membership": None}, "membership"), ({"membership": ["a", None]}, "membership"), ({"extractor_revision": "token"}, "extractor")]),
    "proposal": (DERIVED | {"job_id": "j", "owner_id": "o", "proposal_hash": "0" * 64, "manifest_hash": DIGEST, "fencing_token": 0, "membership": ["a", "b"]}, POLICY + [({"job_id": None}, "job"), ({"owner_id": ""}, "holder"), ({"proposal_hash": "0" * 63}, "proposal hash"), ({"fencing_token": None}, "fence"), ({"membership": ["a", "my secret"]}, "membership"), ({"manifest_hash": "0"}, "manifest"), ({"membership": ["a", "c"]}, "manifest")]),
    "coverage": (DERIVED | {"episode_id": "e", "extractor_revision": "x1"}, POLICY + [({"episode_id": None}, "episode"), ({"extractor_revision": None}, "extractor")]),
    "evidence_link": (DERIVED | {"source_id": "s", "target_id": "t", "job_id": "j", "extractor_revision": "x1"}, POLICY + [({"source_id": "bearer"}, "source"), ({"target_id": None}, "target"), ({"job_id": ""}, "job"), ({"extractor_revision": ""}, "extractor")]),
    "conflict_manifest": (DERIVED | {"state_key": "token", "members": ["a", "b"]}, POLICY + [({"state_key": None}, "state key"), ({"members": ["a"]}, "members"), ({"members": [f"m{i:05}" for i in range(1025)]}, "members"), ({"members": ["b", "a"]}, "members")]),
    "collection_control": (DERIVED | {"version": 1, "active_generation": None, "active_base_generation": "g", "state": "active", "scan_cursor": None, "last_forget_barrier": None, "revoked_destination_ids": []}, POLICY + [({"version": 0}, "version"), ({"active_generation": ""}, "generation"), ({"state": "gone"}, "state"), ({"scan_cursor": ""}, "cursor"), ({"last_forget_barrier": -1}, "barrier"), ({"revoked_destination_ids": ["a b"]}, "destinations"), ({"revoked_destination_ids": ["d", "d"]}, "destinations"), ({"revoked_destination_ids": None}, "destinations"), ({"revoked_destination_ids": ["my-token"]}, "destinations")]),
    "processing_policy": ({"id": "pol1", "policy_id": "pol1", "policy_owner_host": "alpha", "policy_expires_at": None, "canonical_hash": "pol1"}, [({"policy_owner_host": "beta"}, "policy owner"), ({"policy_expires_at": 5}, "policy envelope"), ({"processing_policy_id": "pol2"}, "policy envelope"), ({"canonical_hash": "z"}, "policy hash")]),
    "curated_current": (DERIVED | {"version": 1, "state_key": "k", "project_id": None, "scope": "project", "resolution": "resolved", "content_id": "c", "observation_id": "o", "text": "t", "conflict_manifest_hash": None, "source_episode_ids": None}, POLICY + [({"version": None}, "version"), ({"state_key": ""}, "state key"), ({"project_id": ""}, "project"), ({"scope": ""}, "scope"), ({"resolution": "maybe"}, "resolution"), ({"text": None}, "resolved"), ({"conflict_manifest_hash": "m"}, "resolved"), ({"resolution": "conflict", "conflict_manifest_hash": "m"}, "conflict"), ({"resolution": "conflict", "content_id": None, "observation_id": None, "text": None}, "conflict"), ({"resolution": "conflict", "content_id": None, "observation_id": None, "text": None, "conflict_manifest_hash": "m"}, "valid"), ({"source_episode_ids": ["b", "a"]}, "sources")]),
    "raptor_summary": (DERIVED | {"generation_id": "g", "cluster_id": "c", "membership_hash": DIGEST, "level": 0, "member_ids": ["a", "b"], "manifest_hash": None, "summary": "s", "model_id": "m", "embedding_dimension": 1024, "prompt_revision": "p", "algorithm": "a", "seed": 7, "job_id": "j", "fencing_token": 1, "temporal_from": 5, "temporal_to": 5, "covered_projects": ["p"], "algorithm_parameters": "{}"}, POLICY + [({"generation_id": None}, "generation"), ({"cluster_id": ""}, "cluster"), ({"level": -1}, "level"), ({"member_ids": None}, "closure"), ({"member_ids": None, "manifest_hash": ""}, "manifest"), ({"member_ids": None, "manifest_hash": "m"}, "valid"), ({"member_ids": []}, "members"), ({"member_ids": ["a"]}, "membership hash"), ({"summary": "x" * 16_001}, "summary"), ({"model_id": None}, "model"), ({"embedding_dimension": 3}, "dimension"), ({"prompt_revision": ""}, "prompt"), ({"algorithm": None}, "algorithm"), ({"seed": 2**32}, "seed"), ({"job_id": None}, "job"), ({"fencing_token": -1}, "fence"), ({"temporal_to": 4}, "range"), ({"covered_projects": None}, "projects"), ({"algorithm_parameters": "x" * 4097}, "parameters")]),
}


@pytest.mark.parametrize("record_type", CASES)
def test_rules(spark, record_type):
    own, changes = CASES[record_type]
    whole = BASE | own
    cases = [({}, "valid"), *(c for c in ENVELOPE if record_type != "processing_policy" or c[1] not in ("policy", "id")), *changes]
    kind = lambda c: "array<string>" if c in LISTS else TYPES.get(c, "string")
    schema = ", ".join(f"{c} {kind(c)}" for c in whole)
    rows = [tuple((whole | change).values()) for change, _ in cases]
    # one task: rows come back in their order
    got = [r.reason for r in va.validate(spark.createDataFrame(rows, schema).coalesce(1), record_type).collect()]
    expected = [reason for _, reason in cases]
    assert list(zip(cases, got, strict=True)) == list(zip(cases, expected, strict=True))
    with pytest.raises(ValueError, match="has no field"):
        va.validate(spark.createDataFrame(rows[:1], schema).withColumnRenamed("content_hash", "other"), record_type)
