"""The durable outbox as a data source: batch and stream reads by producer, writes that a killed writer cannot half do.

A job is a file ``<producer>/<sequence>-<hash of its id>.json``. Tasks write drafts aside;
only the commit, which has all of them, numbers and renames them into place, so what a
killed writer leaves is never read. A stream's offset is the last sequence of each
producer: every file is read once, a malformed one too, which comes as a row with an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "producer_id string, sequence long, job_id string, payload string, error string"
#: Jobs that an outbox holds at most, and files that one task of a stream reads.
CAPACITY, FILES_A_TASK = 10_000, 256


def audit_hash(producer_id: str, job_id: str, payload: str) -> str:
    return hashlib.sha256(json.dumps([producer_id, job_id, payload]).encode()).hexdigest()


class _Folder:
    """The files below an outbox's path, on any file system that pyarrow opens by URI."""

    def __init__(self, path: str) -> None:
        self.files, self.root = fs.FileSystem.from_uri(path)

    def listed(self) -> dict[str, list[tuple[int, str]]]:
        """(sequence, path) of each producer's files, in order."""
        found: dict[str, list[tuple[int, str]]] = {}
        for info in self.files.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            producer, _, name = info.path[len(self.root) :].strip("/").rpartition("/")
            if info.type == fs.FileType.File and name.endswith(".json") and name[:12].isdigit() and producer and not producer.startswith("."):
                found.setdefault(producer, []).append((int(name[:12]), info.path))
        return {producer: sorted(files) for producer, files in sorted(found.items())}

    def read(self, path: str) -> bytes:
        with self.files.open_input_stream(path) as lines:
            return lines.read()

    def write(self, path: str, body: str) -> None:
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(path) as out:
            out.write(body.encode())


@dataclass
class Files(InputPartition):
    """Some files of one producer."""

    producer: str
    files: list[tuple[int, str]]


@dataclass
class Drafts(WriterCommitMessage):
    """(producer, job id, path) of what a task wrote aside."""

    drafts: list[tuple[str, str, str]]


def _rows(path: str, part: Files) -> Iterator[tuple]:
    folder = _Folder(path)
    for sequence, file in part.files:
        try:
            job = json.loads(folder.read(file))
            whole = set(job) == {"producer_id", "job_id", "payload", "audit_hash"} and all(isinstance(v, str) for v in job.values())
            if not whole or job["producer_id"] != part.producer or job["audit_hash"] != audit_hash(job["producer_id"], job["job_id"], job["payload"]):
                raise ValueError("audit hash does not hold")
            yield part.producer, sequence, job["job_id"], job["payload"], None
        except (ValueError, TypeError) as malformed:
            yield part.producer, sequence, None, None, str(malformed)[:200]


def _partitions(producer: str, files: list[tuple[int, str]]) -> list[Files]:
    return [Files(producer, files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)]


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Files]:
        return [p for producer, files in _Folder(self.path).listed().items() for p in _partitions(producer, files)] or [Files("", [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {producer: files[-1][0] for producer, files in _Folder(self.path).listed().items()}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        listed = _Folder(self.path).listed()
        return [p for producer, last in sorted(end.items()) for p in _partitions(producer, [f for f in listed.get(producer, []) if start.get(producer, -1) < f[0] <= last])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        """Files stay until their job is settled; the offset alone says what was read."""


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema) -> None:
        self.path, self.names = path, [f.name for f in schema]

    def write(self, rows: Iterator) -> Drafts:
        folder, drafts = _Folder(self.path), []
        for row in rows:
            job = dict(zip(self.names, row, strict=True))
            producer, job_id, payload = job["producer_id"], job["job_id"], job["payload"]
            draft = f"{folder.root}/.drafts/{uuid.uuid4().hex}"
            folder.write(draft, json.dumps({"producer_id": producer, "job_id": job_id, "payload": payload, "audit_hash": audit_hash(producer, job_id, payload)}))
            drafts.append((producer, job_id, draft))
        return Drafts(drafts)

    def commit(self, messages: list[Drafts | None]) -> None:
        """Number the new jobs of each producer and move them into place; one that is there already is not written again."""
        folder = _Folder(self.path)
        listed = folder.listed()
        drafts = sorted(d for message in messages if message for d in message.drafts)
        known = {producer: {path.rpartition("-")[2] for _, path in files} for producer, files in listed.items()}
        last = {producer: files[-1][0] for producer, files in listed.items()}
        if sum(map(len, known.values())) + len(drafts) > CAPACITY:
            self.abort(messages)
            raise ValueError(f"the outbox holds at most {CAPACITY} jobs")
        for producer, job_id, draft in drafts:
            name = hashlib.sha256(job_id.encode()).hexdigest()[:32] + ".json"
            if name in known.setdefault(producer, set()):
                folder.files.delete_file(draft)
                continue
            known[producer].add(name)
            last[producer] = last.get(producer, -1) + 1
            folder.files.create_dir(f"{folder.root}/{producer}", recursive=True)
            folder.files.move(draft, f"{folder.root}/{producer}/{last[producer]:012d}-{name}")

    def abort(self, messages: list[Drafts | None]) -> None:
        folder = _Folder(self.path)
        for message in messages:
            for _, _, draft in message.drafts if message else ():
                folder.files.delete_file(draft)


class OutboxSource(DataSource):
    """``format("memory_outbox")`` with the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "memory_outbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema)


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Append jobs (producer_id, job_id, payload); a job that is there already stays as it is."""
    jobs.sparkSession.dataSource.register(OutboxSource)
    jobs.select("producer_id", "job_id", "payload").write.format("memory_outbox").option("path", path).mode("append").save()


def drain(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Read what is new since the last call, and return (jobs, quarantine) as they are in all.

    Jobs and malformed files go to tables of their own, by batch, so a batch that is run
    again replaces itself and each file is told once.
    """
    spark.dataSource.register(OutboxSource)

    def settle(batch: DataFrame, number: int) -> None:
        batch.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{folder}/jobs/batch={number}")
        batch.filter("error IS NOT NULL").select("producer_id", "sequence", "error").write.mode("overwrite").parquet(f"{folder}/quarantine/batch={number}")

    stream = spark.readStream.format("memory_outbox").option("path", path).load()
    stream.writeStream.foreachBatch(settle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    jobs = spark.read.schema("producer_id string, sequence long, job_id string, payload string").parquet(f"{folder}/jobs").drop("batch")
    return jobs, spark.read.schema("producer_id string, sequence long, error string").parquet(f"{folder}/quarantine").drop("batch")


def payloads(jobs: DataFrame) -> DataFrame:
    """Deterministic jobs as an outbox takes them: the session is the producer."""
    return jobs.select(F.col("session_id").alias("producer_id"), "job_id", F.to_json(F.struct("chunk", "size", "created_at", "bytes")).alias("payload"))
