"""A versioned table over Parquet: a commit is one new file of a log, and only one writer can make it.

Rows go to Parquet first; they are part of the table only when a commit names their
folder. A commit is a small JSON file called by its version and created by a rename that
fails where the name exists, so of two writers of one version exactly one wins and the
other reads again. What a crash leaves between files and commit is never read, and
``sweep`` removes it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Stale(Exception):
    """Another writer committed first."""


@dataclass(frozen=True)
class Ledger:
    """A table at ``path`` with one current row for each value of ``key``."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "id"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        folder, fs = self._fs(f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def commits(self, version: int | None = None) -> list[dict]:
        """The commits up to a version, in order; a row each commit, not each record."""
        last = self.version() if version is None else version
        if not last:
            return []
        files = [self._log(v) for v in range(1, last + 1)]
        lines = self.spark.read.schema("version long, folder string, n_rows long, note string").json(files)
        found = sorted((r.asDict() for r in lines.collect()), key=lambda c: c["version"])
        if [c["version"] for c in found] != list(range(1, last + 1)):
            raise RuntimeError("the log has a gap")
        return found

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version: the latest of each key, with ``_version``, that of its commit."""
        parts = [f"{self.path}/data/{c['folder']}" for c in self.commits(version) if c["n_rows"]]
        schema = f"{self.schema}, _version long"
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*parts)
        latest = Window.partitionBy(self.key).orderBy(F.desc("_version"))
        return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")

    def commit(self, rows: DataFrame, base: int, note: str = "") -> int:
        """Make ``rows`` the version after ``base``; Stale if that exists already."""
        folder, version = uuid.uuid4().hex, base + 1
        # the commit's version is part of the rows, so the log need not be joined to read them
        rows.withColumn("_version", F.lit(version).cast("long")).write.parquet(f"{self.path}/data/{folder}")
        n = self.spark.read.parquet(f"{self.path}/data/{folder}").count()
        self._put_if_absent(version, json.dumps({"version": version, "folder": folder, "n_rows": n, "note": note}))
        return version

    def _put_if_absent(self, version: int, text: str) -> None:
        target, fs = self._fs(self._log(version))
        fs.mkdirs(target.getParent())
        draft, _ = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        # a file context's rename without overwrite fails where the target exists, on file systems and HDFS alike
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, target, options)
        except Exception as failed:
            fs.delete(draft, False)
            if fs.exists(target):
                raise Stale(f"version {version} exists") from failed
            raise

    def update(self, change: Callable[[DataFrame], DataFrame], note: str = "", tries: int = 20) -> int:
        """Commit what ``change`` makes of the current rows; read again and repeat when another was first.

        ``change`` returns the rows to write, of the table's schema; it may be called more
        than once. No rows are no commit, and the version stays.
        """
        for attempt in range(tries):
            base = self.version()
            rows = change(self.read(base))
            if rows.isEmpty():
                return base
            try:
                return self.commit(rows, base, note)
            except Stale:
                time.sleep(min(1.0, 0.01 * 2**attempt))
        raise Stale(f"others were first {tries} times")

    def insert_only(self, rows: DataFrame, hash_column: str = "content_hash") -> tuple[int, DataFrame]:
        """Insert new keys and report every row: inserted, existing (equal hash) or collision (another hash).

        A collision, or two rows of one key with unequal hashes, is never written.
        """
        def judged(now: DataFrame) -> DataFrame:
            own = Window.partitionBy(self.key)
            twice = rows.withColumn("_min", F.min(hash_column).over(own)).withColumn("_max", F.max(hash_column).over(own)).withColumn("_k", F.row_number().over(own.orderBy(hash_column)))
            known = now.select(self.key, F.col(hash_column).alias("_held"))
            outcome = F.when(F.col("_min") != F.col("_max"), "collision").when(F.col("_held").isNull() & (F.col("_k") == 1), "inserted").when(F.coalesce(F.col("_held"), F.col("_max")) == F.col(hash_column), "existing").otherwise("collision")
            return twice.join(known, self.key, "left").withColumn("outcome", outcome).drop("_min", "_max", "_k", "_held")

        before = self.version()
        names = [c.split()[0] for c in self.schema.split(", ")]
        last = self.update(lambda now: judged(now).filter("outcome = 'inserted'").select(*names), "insert")
        # the report is about the table that the rows were judged against
        return last, judged(self.read(last - 1 if last > before else last))

    def compare_and_set(self, changes: DataFrame, expected: str = "expected_version", version: str = "version") -> tuple[int, DataFrame]:
        """Write the rows whose key is at the version that they expect, and report all: applied or stale.

        ``changes`` has the table's columns and ``expected``; a written row's version is
        one more. A key of no row is at version 0. Of several changes of a key in one
        call none is applied.
        """
        names = [c.split()[0] for c in self.schema.split(", ")]

        def judged(now: DataFrame) -> DataFrame:
            n = F.count(F.lit(1)).over(Window.partitionBy(self.key))
            held = now.select(self.key, F.col(version).alias("_at"))
            joined = changes.withColumn("_n", n).join(held, self.key, "left")
            fits = (F.coalesce("_at", F.lit(0)) == F.col(expected)) & (F.col("_n") == 1)
            return joined.withColumn("outcome", F.when(fits, "applied").otherwise("stale")).withColumn(version, F.col(expected) + 1).drop("_n", "_at")

        before = self.version()
        last = self.update(lambda now: judged(now).filter("outcome = 'applied'").select(*names), "compare and set")
        return last, judged(self.read(last - 1 if last > before else last))

    def sweep(self, older_than_ms: int) -> int:
        """Remove folders that no commit names and no writer can still be about to commit."""
        folder, fs = self._fs(f"{self.path}/data")
        if not fs.exists(folder):
            return 0
        named = {c["folder"] for c in self.commits()}
        lost = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named and s.getModificationTime() < older_than_ms]
        for path in lost:
            fs.delete(path, True)
        return len(lost)
