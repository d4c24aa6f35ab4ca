"""Capture as Structured Streaming: at least once in, each id once out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators.coordination import audit_hash
from palimpsest.sources.records import BASE_MS, SKEW_MS, table
from palimpsest.sources.shared import new_folder, written

KINDS = ("user", "assistant")


def captured(entries: DataFrame) -> DataFrame:
    """Episodes of finalized entries."""
    return entries.filter(F.col("role").isin(*KINDS)).select(F.concat(F.lit("ep-"), "conv_id", F.lit("-"), "turn").alias("id"), "role", "text")


def write_batch(batch: DataFrame, number: int | str, path: str) -> None:
    """A batch goes to a folder of its own, so one that is run again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def sweep(entries: DataFrame, sink: DataFrame) -> DataFrame:
    """Entries that the sink lacks, each id once: the periodic pass that no cursor can miss anything in."""
    return entries.join(sink.select("id"), "id", "left_anti").dropDuplicates(["id"])


def deduplicated(entries: DataFrame, skew_ms: int = SKEW_MS) -> DataFrame:
    """A stream's episodes, each id once within the clock skew: ids older than that leave the state.

    An entry that comes later than the skew allows is not let through; ``sweep`` finds it.
    """
    timed = entries.withColumn("event_time", F.timestamp_millis(F.lit(BASE_MS) + F.col("conv_id") * 600_000 + F.col("turn") * 1000))
    kept = timed.filter(F.col("role").isin(*KINDS)).withColumn("id", F.concat(F.lit("ep-"), "conv_id", F.lit("-"), "turn"))
    return kept.withWatermark("event_time", f"{skew_ms} milliseconds").dropDuplicatesWithinWatermark(["id"]).select("id", "role", "text")


def run_capture(spark: SparkSession, source: str, schema: StructType, out: str) -> DataFrame:
    """Run the stream over the files at hand, then sweep what it let pass, and return the sink; called again, it goes on.

    The state holds the ids of the last skew only. The sweep is an anti-join of entries
    and sink, so late entries are captured once, however late.
    """
    entries = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    stream = deduplicated(entries).writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, f"{out}/sink")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    columns = "id string, role string, text string"
    # read as it is before the sweep adds to it
    sink = spark.read.schema(columns).parquet(f"{out}/sink")
    missed = written(sweep(captured(spark.read.schema(schema).parquet(source)), sink.select("id").distinct()), "missed")
    number = (stream.lastProgress or {"batchId": 0})["batchId"]
    write_batch(missed, f"after-{number}-{uuid.uuid4().hex}", f"{out}/sink")
    # a batch that ran twice, or an id that came again beyond the skew, is one row
    return spark.read.schema(columns).parquet(f"{out}/sink").dropDuplicates(["id"])


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all entries, captured by the stream and its sweep."""
    schema = table(spark, sf_dir, "conversations").schema
    return run_capture(spark, f"{sf_dir}/conversations.parquet*", schema, new_folder(spark, "capture")).select("id")


def write_outbox(jobs: DataFrame, path: str) -> None:
    """Jobs as JSON files, one row a line; written again, the same jobs replace themselves."""
    jobs.write.mode("overwrite").json(path)


def read_outbox(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, malformed): jobs whose audit hash holds, and the lines that are no such job, as they were read."""
    schema = "session_id string, chunk long, size long, created_at long, bytes long, job_id string, audit_hash string"
    lines = spark.read.text(path).withColumn("j", F.from_json("value", schema))
    whole = lines.select("value", "j.*").withColumn("good", F.coalesce(F.col("audit_hash") == audit_hash(), F.lit(False)))
    return whole.filter("good").drop("value", "good"), whole.filter("NOT good").select("value")
