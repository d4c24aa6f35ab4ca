"""Where callers plug in their own services: scanners, embedders, completers, summarisers.

Each is a plain Python callable that runs in Arrow batches on the executors. What it
returns is bounded and checked; what it raises becomes an error of the row, not of the job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.secrets import checked
from palimpsest.functions.text import strict_json

MAX_COMPLETION = 65_536


def screened(rows: DataFrame, column: str, scanner: Callable[[str], str], home: str = "/") -> DataFrame:
    """Rows whose text passes redaction, the built-in scan and then ``scanner``, with the redacted text.

    The injected scanner only restricts: it never sees, nor promotes, what the scan here rejected.
    """
    judged = rows.withColumn("_checked", checked(F.col(column), home=home, scanner=scanner))
    return judged.filter(F.col("_checked.verdict") == "passed").withColumn(column, F.col("_checked.text")).drop("_checked")


def embed(rows: DataFrame, column: str, embedder: Callable[[Sequence[str]], Sequence[Sequence[float]]], dimensions: int, prefix: str = "") -> DataFrame:
    """Rows with ``vector``: unit vectors of single precision from a batch embedder; null where the text is.

    A vector of another length, with a number that is not finite, or of length zero is an
    error and null. ``prefix`` goes before each text, as queries want.
    """

    def unit(v) -> list[float] | None:
        norm = math.sqrt(sum(float(x) ** 2 for x in v)) if len(v) == dimensions else 0.0
        return [float(x) / norm for x in v] if norm and math.isfinite(norm) else None

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        if known.any():
            out[known] = pd.Series([unit(v) for v in embedder([prefix + t for t in texts[known]])], index=texts.index[known], dtype=object)
        return out

    return rows.withColumn("vector", run(F.col(column)))


def complete(rows: DataFrame, column: str, completer: Callable[[str], str], most: int = MAX_COMPLETION) -> DataFrame:
    """Rows with ``completion`` and ``error``: what a completer says to each prompt, if it is a text within bounds."""

    def one(prompt) -> tuple[str | None, str | None]:
        if not isinstance(prompt, str):
            return None, "no prompt"
        try:
            said = completer(prompt)
        except Exception as failed:  # a service that fails is an error of this row
            return None, type(failed).__name__
        return (said, None) if isinstance(said, str) and 0 < len(said) <= most else (None, "unbounded")

    @F.pandas_udf("completion string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p) for p in prompts], columns=["completion", "error"])

    return rows.withColumn("_said", run(F.col(column))).withColumns({"completion": F.col("_said.completion"), "error": F.col("_said.error")}).drop("_said")


def summarise(members: DataFrame, summariser: Callable[[Sequence[str]], str], most_tokens: int) -> DataFrame:
    """(cluster, summary): a summary of the member texts of each cluster (cluster, member, text), children only.

    Texts go in order of member; a cluster whose texts are beyond four bytes a token is
    refused with an error rather than cut.
    """
    held = members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("member", "text"))).alias("m"), F.sum(F.octet_length("text")).alias("bytes"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: summariser(list(t)) if t is not None else None)

    fits = F.col("bytes") <= 4 * most_tokens
    return held.select("cluster", run(F.when(fits, F.col("m.text"))).alias("summary"), F.when(~fits, "over budget").alias("error"))


@F.pandas_udf("boolean")
def strict(texts: pd.Series) -> pd.Series:
    """Whether a text is strict JSON: an object or list, no repeated or reserved keys, nothing around it."""

    def one(text) -> bool:
        try:
            return isinstance(strict_json(text), (dict, list))
        except (ValueError, TypeError, RecursionError):
            return False

    return texts.map(one)
