"""What the corpus operators share: the shared scratch folder and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of the Arrow batches that Python workers get at most.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and everything
    runs in one JVM, as in tests, a folder of this process takes its place; on a cluster
    that is an error, since no executor would see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one; ``clear_scratch`` and the end of the driver remove it."""
    path = f"{shared_dir(spark)}/palimpsest/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(clear_scratch)
    _made.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(since: int = 0, keep: str | None = None) -> None:
    """Remove the scratch tables that this driver wrote, from the ``since``-th on; results that read them are lost."""
    for spark, path in _made[since:]:
        if path != keep:
            with contextlib.suppress(Exception):  # a session that has ended removes nothing
                _remove(spark, path)
    _made[since:] = [made for made in _made[since:] if made[1] == keep]


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches within BATCH_ROWS and BATCH_BYTES.

    Texts may be long: 10,000 rows, Spark's default, can outgrow a worker.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, str(most)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts lineage: an executor lost later does not repeat the work before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``make`` returns, and remove all other scratch tables that it wrote on the way."""
    since = len(_made)
    out = materialize(make(), name)
    clear_scratch(since, keep=_made[-1][1])
    release(out.sparkSession)
    return out


def discard(df: DataFrame) -> None:
    """Remove the files that ``materialize`` wrote for ``df``, once nothing needs them."""
    for file in df.inputFiles()[:1]:
        _remove(df.sparkSession, file)
        folder = file.rpartition("/")[0].partition("palimpsest/")[2]
        _made[:] = [made for made in _made if not made[1].endswith(folder)]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b``; null ends and loops count for
    nothing and repeated edges are harmless. Returns (node, component) for each
    node that has an edge. Alternates large-star and small-star steps, so the rounds
    grow with the logarithm of the longest path; each step is one aggregation with
    map-side combine and one plain equi-join, which adaptive execution may split on
    a node that many edges share. Every round is written to the shared folder.
    """
    now = materialize(
        edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        large = _star(now, both=True)
        small = _star(large, both=False)
        same = _signature(small) == _signature(now)
        discard(large)
        discard(now)
        now = small
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One large-star (``both``) or small-star step over edges (u, v) with u > v."""
    if both:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges
    least = materialize(arcs.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = arcs.join(least, "u")
    if both:
        # neighbours larger than u move to the smallest of u and its neighbours
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        # u itself and its smaller neighbours move to the smallest
        moved = joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
    out = materialize(moved.filter("u <> v").distinct(), "large" if both else "small")
    discard(least)
    return out


def _signature(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set, independent of order."""
    half = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum(half.bitwiseAND(F.lit(0xFFFFFFFF))),
        F.sum(F.shiftrightunsigned(half, 32)),
    ).first()
    return tuple(row)


def bounded_slices(frame: pd.DataFrame, rows: int = 512, chars: int = 1_000_000, column: str = "text") -> Iterator[pd.DataFrame]:
    """Consecutive parts of an Arrow batch with at most ``rows`` rows and about ``chars`` characters.

    A single longer text is a part of its own, so memory follows the longest text and
    not the length of a batch.
    """
    start, held = 0, 0
    for i, text in enumerate(frame[column]):
        size = len(text) if isinstance(text, str) else 0
        if i > start and (i - start >= rows or held + size > chars):
            yield frame.iloc[start:i]
            start, held = i, 0
        held += size
    if len(frame) > start:
        yield frame.iloc[start:]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished work whose frames are gone."""
    gc.collect()
    spark._jvm.System.gc()
