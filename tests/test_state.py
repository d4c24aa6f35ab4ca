"""Streams with keyed state: the same as batches, whatever the cut, and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import temporal
from palimpsest.operators.coordination import retry_delay
from palimpsest.sources import records as rec
from palimpsest.streaming import state

SF = "/root/testdata/sf0.001"


def fed(spark, folder, name, parts, schema):
    """A stream over files that are added one by one, each run on its own; what it said in all."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        yield spark.readStream.schema(schema).parquet(f"{folder}/{name}"), n


@pytest.mark.parametrize("cuts", [[300], [1, 2, 500, 900]])
def test_current_equals_the_fold_for_any_cut(spark, tmp_path, cuts):
    observations = rec.observations(spark, SF).select("state_key", "effective_at", "content_id", "id", "created_at")
    want = {r.state_key: (r.kind, r.content, r["at"], r.members, r.version) for r in temporal.fold_current(observations, rec.SKEW_MS).collect()}
    rows = [tuple(r) for r in observations.orderBy("created_at", "id").collect()]
    parts = [rows[i:j] for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    for events, _ in fed(spark, str(tmp_path), "observations", parts, observations.schema):
        said = state.run(state.stateful(events, "state_key", state.Current(rec.SKEW_MS)), str(tmp_path))
    last = said.groupBy("state_key").agg(F.max_by(F.struct("kind", "content", "at", "members", "version"), "version").alias("v")).collect()
    assert {r.state_key: tuple(r.v) for r in last} == want


def test_current_goes_on_from_a_table(spark, tmp_path):
    observations = rec.observations(spark, SF).select("state_key", "effective_at", "content_id", "id", "created_at")
    want = {r.state_key: (r.kind, r.content, r["at"], r.members, r.version) for r in temporal.fold_current(observations, rec.SKEW_MS).collect()}
    rows = [tuple(r) for r in observations.orderBy("created_at", "id").collect()]
    early = spark.createDataFrame(rows[:600], observations.schema)
    table = temporal.fold_current(early, rec.SKEW_MS)
    known = {r.state_key: (r.kind, r.content, r["at"], r.members, r.version) for r in table.collect()}
    table.write.parquet(f"{tmp_path}/table")
    initial = spark.read.parquet(f"{tmp_path}/table").select("state_key", "kind", "content", "at", "members", "version")
    for events, _ in fed(spark, str(tmp_path), "observations", [rows[600:]], observations.schema):
        said = state.run(state.stateful(events, "state_key", state.Current(rec.SKEW_MS), initial=initial), str(tmp_path))
    last = said.groupBy("state_key").agg(F.max_by(F.struct("kind", "content", "at", "members", "version"), "version").alias("v")).collect()
    assert known | {r.state_key: tuple(r.v) for r in last} == want


EVENT = "job_id string, at long, seq long, kind string, owner_id string, held_version long, held_fence long"


def test_leases_with_timers_and_restart(spark, tmp_path):
    """Claims, thefts, renewals and refusals as one after the other; what lapses is told once."""
    rng = random.Random(5)
    events, want, now, at = [], [], {}, 1_000_000
    for seq in range(400):
        at += rng.randrange(1, 4000)
        job, kind = f"job{rng.randrange(6)}", rng.choice(["claim", "claim", "renew", "renew", "release", "complete" if seq > 300 else "renew"])
        held = now.get(job) if rng.random() < 0.7 else None
        owner, version, fence = (held["owner_id"], held["version"], held["fencing_token"]) if held else (f"node{rng.randrange(2)}", 1, 1)
        events.append((job, at, seq, kind, owner, version, fence))
        now[job], outcome = state.lease_step(now.get(job), kind, owner, at, version, fence, 500, 5000)
        want.append((job, at, kind, outcome))
    parts = [events[:150], events[150:151], events[151:]]
    for stream, _ in fed(spark, str(tmp_path), "events", parts, EVENT):
        said = state.run(state.stateful(stream, "job_id", state.Leases(500, 5000), lateness="0 seconds"), str(tmp_path))
    rows = said.collect()
    assert sorted((r.job_id, r["at"], r.kind, r.outcome) for r in rows if r.kind != "timer") == sorted(want)
    lapsed = [(r.job_id, r.version) for r in rows if r.kind == "timer"]
    assert lapsed and len(lapsed) == len(set(lapsed))
    assert {o for *_, o in want} == {"fresh", "held", "refreshed", "stolen", "renewed", "released", "completed", "refused"}


def test_retries_wait_and_ring(spark, tmp_path):
    schema = "job_id string, at long, seq long, result string, deadline long"
    first = [("a", 1000, 0, "failed", None), ("b", 1000, 1, "done", None), ("c", 1000, 2, "refused", None), ("d", 1000, 3, "new", 900)]
    later = [("a", 100_000, 4, "failed", None), ("b", 100_000, 5, "failed", None), ("e", 100_000, 6, "new", None)]
    last = [("e", 300_000, 7, "done", None)]
    for stream, _ in fed(spark, str(tmp_path), "events", [first, [("z", 50_000, 8, "new", None)], later, [*last, ("z", 900_000, 9, "done", None)]], schema):
        said = state.run(state.stateful(stream, "job_id", state.Retries(), lateness="0 seconds"), str(tmp_path))
    got = {}
    for r in said.orderBy("at").collect():
        got.setdefault(r.job_id, []).append((r.outcome, r.attempts, r.next_at))
    waits = [r[0] for r in spark.range(2).select(retry_delay(F.lit("a"), F.col("id") + 1, 500, 30_000)).collect()]
    assert [o for o, _, _ in got["a"]] == ["retry", "due", "retry", "due"]
    assert got["a"][0][2] == 1000 + waits[0] and got["a"][2][2] == 100_000 + waits[1]
    assert got["b"] == [("delivered", 0, 1000)] and got["c"][0][0] == "quarantined" and got["d"][0][0] == "quarantined"
    assert [o for o, _, _ in got["e"]] == ["due", "delivered"]


def test_a_key_costs_one_read():
    class Value:
        calls = 0

        def get(self):
            Value.calls += 1

        def exists(self):
            Value.calls += 1
            return False

    machine = state.Leases(0, 60_000)
    machine.value = Value()
    assert machine.load() is None and Value.calls == 1
    held = {"owner_id": "a", "version": 1, "fencing_token": 1, "expires_at": 5, "state": "leased"}
    machine.names, machine.value = list(held), type("Held", (), {"get": lambda self: tuple(held.values())})()
    assert machine.load() == held


@pytest.mark.parametrize("cuts", [[500], [1, 2, 130, 499]])
def test_keys_of_a_bucket_stay_apart(spark, tmp_path, monkeypatch, cuts):
    """Leases without timers, many to a bucket, as one after the other for any cut; longs stay exact beside nulls."""
    monkeypatch.setattr(state, "BUCKETS", 3)
    rng, far = random.Random(7), 2**60 + 1
    events, want, now, at = [], [], {}, far
    for seq in range(500):
        at += rng.randrange(1, 400)
        job, kind = rng.choice([f'job"{n},é' for n in range(40)]), rng.choice(["claim", "renew", "release", "complete"])
        held = now.get(job) if rng.random() < 0.7 else None
        owner, version, fence = (held["owner_id"], held["version"], held["fencing_token"]) if held else (f"node{rng.randrange(2)}", None, None)
        events.append((job, at, seq, kind, owner, version, fence))
        now[job], outcome = state.lease_step(now.get(job), kind, owner, at, version, fence, 500, 5000)
        want.append((job, at, kind, outcome, *(now[job] or dict.fromkeys(state.LEASE_FIELDS)).values()))
    parts = [events[i:j] for i, j in zip([0, *cuts], [*cuts, len(events)], strict=True)]
    for stream, _ in fed(spark, str(tmp_path), "events", [p for p in parts if p], EVENT):
        said = state.run(state.stateful(stream, "job_id", state.Leases(500, 5000)), str(tmp_path)).drop("batch")
    assert sorted(map(str, (tuple(r) for r in said.collect()))) == sorted(map(str, want))


def test_a_bucket_costs_one_read_one_write_and_one_batch():
    class Value:
        calls, held = [], None

        def get(self):
            self.calls.append("get")
            return self.held

        def update(self, held):
            self.calls.append("update")
            Value.held = held

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    buckets = state._Buckets(state.Leases(0, 60_000, key="long"), "job_id")
    buckets.init(Handle())
    claims = [f'{{"job_id":{n},"at":5,"seq":0,"kind":"claim","owner_id":"a","held_version":null,"held_fence":null}}' for n in range(1000)]
    told = [*buckets.handleInputRows((1,), iter([state.pd.DataFrame({"event": claims[:600]}), state.pd.DataFrame({"event": claims[600:]})]), None)]
    assert [len(t) for t in told] == [1000] and Value.calls == ["get", "update"] and set(told[0].outcome) == {"fresh"}
    again = [*buckets.handleInputRows((1,), iter([state.pd.DataFrame({"event": claims})]), None)]
    # what changes nothing is not written
    assert set(again[0].outcome) == {"held"} and Value.calls == ["get", "update", "get"]
