"""Keyed state that lasts: current values, leases and retries as streams with timers.

Each machine is one small function of a state and an event; a state store holds one state
for each key, and timers of event time fire when the watermark passes. A stream stopped
anywhere goes on from its checkpoint with the states that it had. Events of a key within
a batch are taken in order of time and sequence, so a trigger bounds what a task sorts.

Machines without timers keep the states of a bucket of keys as one value, since a key's
own calls to the store and its own Arrow batch cost far more than its events do.
"""

from __future__ import annotations

import json
from collections import defaultdict, namedtuple
from collections.abc import Callable, Iterator
from operator import attrgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from palimpsest.functions.identity import retry_wait
from palimpsest.operators.temporal import arrived

CURRENT_STATE = "kind string, content string, at long, members array<string>, version long"
LEASE_STATE = "owner_id string, version long, fencing_token long, expires_at long, state string"
RETRY_STATE = "attempts long, next_at long, deadline long, outcome string"
#: Buckets that the keys of machines without timers are dealt to; a checkpoint is bound to their number.
BUCKETS = 4096


def _struct(ddl: str) -> StructType:
    """A schema of texts, numbers and lists of texts; a worker has no session to parse one."""
    types = {"string": StringType(), "long": LongType(), "array<string>": ArrayType(StringType())}
    return StructType([StructField(name, types[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


class _Machine(StatefulProcessor):
    """One value a key, changed by events in order and by the timer that it asks for."""

    #: ``reads`` names what a step reads of an event beside its order.
    schema, output, order, reads, rings = "", "", (), (), True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", _struct(self.schema))
        self.names, self.told_names = _struct(self.schema).names, _struct(self.output).names

    def load(self) -> dict | None:
        held = self.value.get()  # a call to the store each; a key that is new has none
        return None if held is None else dict(zip(self.names, held, strict=True))

    def store(self, now: dict) -> None:
        self.value.update(tuple(now[name] for name in self.names))

    def wake_at(self, at: int | None) -> None:
        """One timer a key: the last that was asked for."""
        if not self.rings:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def told(self, key: tuple, said: list[tuple]) -> Iterator[Row]:
        return (Row(**dict(zip(self.told_names, (*key, *row), strict=True))) for row in said)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.load()
        now, said = self.steps(key[0], before, rows)
        yield from self.told(key, said)
        # what changes nothing asks for no timer either, so one that rang does not ring again
        if now is not None and now != before:
            self.store(now)
            self.wake_at(self.alarm(now))

    def steps(self, key: Any, now: dict | None, events: Iterator[Any]) -> tuple[dict | None, list[tuple]]:
        """A key's value after its events of a batch, and what they came to."""
        self.key, told = key, []
        for event in sorted(events, key=attrgetter(*self.order)):
            now, said = self.step(now, event)
            told += said
        return now, told

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, said = self.ring(self.load(), expiredTimerInfo.getExpiryTimeInMs())
        yield from self.told(key, said)
        if now is not None:
            self.store(now)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        now = initialState.asDict()
        self.store(now)
        self.wake_at(self.alarm(now))

    def step(self, now: dict | None, event: Row) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def ring(self, now: dict | None, at: int) -> tuple[dict | None, list[tuple]]:
        return now, []

    def alarm(self, now: dict) -> int | None:
        return None

    def close(self) -> None:
        pass


class _Buckets(StatefulProcessor):
    """A machine for many keys whose values are one text: a list of key and fields each.

    Events come as texts too: pandas would make floats of longs where some are null.
    """

    def __init__(self, machine: _Machine, key: str) -> None:
        self.machine, self.columns = machine, _read_columns(machine, key)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("bucket", _struct("held string"))
        self.names, self.told_names = _struct(self.machine.schema).names, _struct(self.machine.output).names

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.value.get()
        states = {k: dict(zip(self.names, fields, strict=True)) for k, *fields in json.loads(held[0])} if held else {}
        event_of, by_key = namedtuple("Event", self.columns), defaultdict(list)
        for frame in rows:
            for fields in json.loads(f"[{','.join(frame['event'])}]"):
                event = event_of._make(fields.values())
                by_key[event[0]].append(event)
        told, changed = [], False
        for own, events in by_key.items():
            before = states.get(own)
            now, said = self.machine.steps(own, before, events)
            told += [(own, *row) for row in said]
            if now is not None and now != before:
                states[own], changed = now, True
        if changed:
            self.value.update((json.dumps([(k, *(state[name] for name in self.names)) for k, state in states.items()]),))
        if told:
            # objects, for the same reason
            yield pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in zip(self.told_names, zip(*told, strict=True), strict=True)})

    def close(self) -> None:
        pass


def _read_columns(machine: _Machine, key: str) -> list[str]:
    return list(dict.fromkeys((key, *machine.order, *machine.reads)))


class Current(_Machine):
    """The current value of a state, and the members of its open conflict."""

    schema, order, reads, rings = CURRENT_STATE, ("created_at", "id"), ("effective_at", "content_id"), False
    output = f"state_key string, {CURRENT_STATE}"

    def __init__(self, skew: int) -> None:
        self.skew = skew

    def step(self, now: dict | None, event: Row) -> tuple[dict | None, list[tuple]]:
        held = None if now is None else now | {"members": set(now["members"])}
        after = arrived(held, event.effective_at, event.content_id, self.skew)
        if held is not None and after["version"] == held["version"]:
            return now, []
        after = after | {"members": sorted(after["members"])}
        return after, [tuple(after[c] for c in ("kind", "content", "at", "members", "version"))]


class Leases(_Machine):
    """A job's lease under claims, renewals, releases and completions; it lapses by itself.

    Events have at, seq, kind, owner_id, held_version and held_fence. An outcome is fresh,
    held, refreshed, stolen, renewed, released, completed or refused; lapsed comes of the
    timer, once expiry and clock skew have passed, and changes nothing: another may take it.
    """

    schema, order, reads = LEASE_STATE, ("at", "seq"), ("kind", "owner_id", "held_version", "held_fence")
    said = f"at long, kind string, outcome string, {LEASE_STATE}"

    def __init__(self, skew: int, lease_ms: int, key: str = "string") -> None:
        self.skew, self.lease_ms, self.output = skew, lease_ms, f"job_id {key}, {self.said}"

    def step(self, now: dict | None, event: Row) -> tuple[dict | None, list[tuple]]:
        after, outcome = lease_step(now, event.kind, event.owner_id, event.at, event.held_version, event.held_fence, self.skew, self.lease_ms)
        shown = after or dict.fromkeys(LEASE_FIELDS)
        return after, [(event.at, event.kind, outcome, *(shown[c] for c in LEASE_FIELDS))]

    def alarm(self, now: dict) -> int | None:
        return now["expires_at"] + self.skew if now["state"] == "leased" else None

    def ring(self, now: dict | None, at: int) -> tuple[dict | None, list[tuple]]:
        if now is None or now["state"] != "leased" or now["expires_at"] + self.skew > at:
            return now, []
        return now, [(at, "timer", "lapsed", *(now[c] for c in LEASE_FIELDS))]


LEASE_FIELDS = ["owner_id", "version", "fencing_token", "expires_at", "state"]


def lease_step(now: dict | None, kind: str, owner: str, at: int, version: int | None, fence: int | None, skew: int, lease_ms: int) -> tuple[dict | None, str]:
    """A lease after one event, and what the event came to."""
    if kind == "claim":
        if now is None:
            return {"owner_id": owner, "version": 1, "fencing_token": 1, "expires_at": at + lease_ms, "state": "leased"}, "fresh"
        free, mine = now["expires_at"] + skew <= at, now["owner_id"] == owner and now["state"] != "released"
        if now["state"] == "completed" or not (mine or free or now["state"] == "released"):
            return now, "refused"
        if mine and now["expires_at"] > at:
            return now, "held"
        if mine and not free:
            return now, "refused"
        taken = {"owner_id": owner, "version": now["version"] + 1, "fencing_token": now["fencing_token"] + 1, "expires_at": at + lease_ms, "state": "leased"}
        return taken, "refreshed" if mine else "stolen"
    exact = now is not None and (now["owner_id"], now["version"], now["fencing_token"]) == (owner, version, fence) and now["expires_at"] > at
    if not exact or now["state"] == "completed":
        return now, "refused"
    changes = {"renew": {"expires_at": at + lease_ms}, "release": {"state": "released"}, "complete": {"state": "completed"}}
    words = {"renew": "renewed", "release": "released", "complete": "completed"}
    if kind not in changes:
        return now, "refused"
    return now | changes[kind] | {"version": now["version"] + 1}, words[kind]


class Retries(_Machine):
    """A job's delivery: it waits longer after each failure, and is due again when its timer rings.

    Events have at, seq, result (new, done, failed, refused) and deadline. Outcomes are
    due, retry, delivered and quarantined; a job that is settled stays so, and one past its
    deadline is quarantined when it is next touched.
    """

    schema, order, reads = RETRY_STATE, ("at", "seq"), ("result", "deadline")
    output = "job_id string, at long, outcome string, attempts long, next_at long"

    def __init__(self, base: int = 500, most: int = 30_000, skew: int = 0) -> None:
        self.base, self.most, self.skew = base, most, skew

    def step(self, now: dict | None, event: Row) -> tuple[dict | None, list[tuple]]:
        now = now or {"attempts": 0, "next_at": event.at, "deadline": event.deadline, "outcome": "due"}
        if now["outcome"] in ("delivered", "quarantined"):
            return now, []
        if now["deadline"] is not None and now["deadline"] <= event.at + self.skew or event.result == "refused":
            now = now | {"outcome": "quarantined"}
        elif event.result == "done":
            now = now | {"outcome": "delivered"}
        elif event.result == "failed":
            wait = retry_wait(str(self.key), now["attempts"] + 1, self.base, self.most)
            now = now | {"outcome": "retry", "attempts": now["attempts"] + 1, "next_at": event.at + wait}
        return now, [(event.at, now["outcome"], now["attempts"], now["next_at"])]

    def alarm(self, now: dict) -> int | None:
        return now["next_at"] if now["outcome"] == "retry" else None

    def ring(self, now: dict | None, at: int) -> tuple[dict | None, list[tuple]]:
        if now is None or now["outcome"] != "retry" or now["next_at"] > at:
            return now, []
        now = now | {"outcome": "due"}
        return now, [(at, "due", now["attempts"], now["next_at"])]


def stateful(events: DataFrame, key: str, machine: _Machine, lateness: str | None = None, initial: DataFrame | None = None, time: str = "at") -> DataFrame:
    """The stream of what a machine says of each key's events.

    With ``lateness`` the events' ``time`` (milliseconds) drives watermark and timers.
    ``initial`` has the key and the machine's state for keys that are known already.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if lateness is None:
        machine.rings = False  # without event time there are no timers
        if initial is None:
            texts = events.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.to_json(F.struct(*_read_columns(machine, key)), {"ignoreNullFields": "false"}).alias("event"))
            return texts.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Buckets(machine, key), outputStructType=machine.output, outputMode="Update", timeMode="None")
    mode = "None"
    if lateness is not None:
        events, mode = events.withColumn("event_time", F.timestamp_millis(time)).withWatermark("event_time", lateness), "EventTime"
    known = None if initial is None else initial.groupBy(key)
    return events.groupBy(key).transformWithState(statefulProcessor=machine, outputStructType=machine.output, outputMode="Update", timeMode=mode, initialState=known)


def run(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what there is now and stop; called again, it goes on from its checkpoint.

    A batch goes to a folder of its own, so one that is run again replaces itself. Returns
    all that the stream has said so far.
    """
    into = sink or (lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/said/batch={number}"))
    stream.writeStream.outputMode("update").foreachBatch(into).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/said")
