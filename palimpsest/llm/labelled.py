"""Labelled training rows and isotonic calibration, for the two classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int | None = None, distinct_texts: bool = False, described: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None
) -> DataFrame:
    """(doc_id, text, y) of all labelled documents outside the held-out remainder.

    A document with several labels has their mean. Both sides are always dealt by id, so that
    disk grows with the input alone: a broadcast would end where the labels outgrow it. With
    ``described`` (batches of doc_id and text to those of doc_id and ``x``, an array of doubles) the
    documents are described first, and rows of (doc_id, x, y) are dealt instead of texts.
    ``distinct_texts`` keeps the smallest id of each text, so that copies do not count
    as independent evidence. Only a caller that gives ``max_rows`` gets about so many, chosen by a hash of the id.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .filter("doc_id IS NOT NULL AND y IS NOT NULL")
        .filter(id_remainder("doc_id", modulus) != held_out)
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    if max_rows is not None and (n := known.count()) > max_rows:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < int(2**32 * max_rows / n))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL").filter(id_remainder("doc_id", modulus) != held_out)
    if distinct_texts:
        hashed = rows.select("doc_id", F.xxhash64("text").alias("h")).join(known.hint("merge"), "doc_id")
        known = hashed.groupBy("h", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y").groupBy("doc_id").agg(F.avg("y").alias("y"))
    if described is not None:
        rows = rows.mapInPandas(described, "doc_id long, x array<double>")
    return rows.join(known.hint("merge"), "doc_id")


Block = tuple[float, float, float, int]


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Pool adjacent violators: blocks (left, right, sum, rows), ascending, until their means rise.

    Pooling runs of blocks first and what is left of them later gives the same.
    """
    out: list[Block] = []
    for left, right, total, n in blocks:
        while out and out[-1][2] * n >= total * out[-1][3]:
            left, _, add, size = out.pop()
            total, n = total + add, n + size
        out.append((left, right, total, n))
    return out


def isotonic_of(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``isotonic`` of all rows (s, y): pooled within ranges of the score by tasks, then over the blocks that are left."""

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, s, y, n) for batch in batches for s, y, n in batch[["s", "y", "n"]].itertuples(index=False))
        yield pd.DataFrame(pooled(rows), columns=["lo", "hi", "y", "n"])

    each = pairs.groupBy("s").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    blocks = each.repartitionByRange("s").sortWithinPartitions("s").mapInPandas(pool, "lo double, hi double, y double, n long").collect()
    return _knots(pooled(sorted((r.lo, r.hi, r.y, r.n) for r in blocks)))


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of ``y`` on ``scores`` (pool adjacent violators).

    Each block is smoothed towards the overall rate by one pseudo-row, so that no score
    is exactly 0 or 1. Without rows the fit is 0.5 everywhere.
    """
    if len(scores) == 0:
        return _knots([])
    order = np.argsort(scores, kind="stable")
    s, first, n = np.unique(scores[order], return_index=True, return_counts=True)
    total = np.add.reduceat(y[order], first)
    return _knots(pooled(zip(s.tolist(), s.tolist(), total.tolist(), n.tolist(), strict=True)))


def _knots(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    if not blocks:
        return np.asarray([0.0]), np.asarray([0.5])
    left, right, sums, counts = (np.asarray(part, dtype=float) for part in zip(*blocks, strict=True))
    rate = float(sums.sum() / counts.sum())
    fitted = np.maximum.accumulate((sums + rate) / (counts + 1.0))
    knots, values = [], []
    for a, b, v in zip(left, right, fitted, strict=True):
        knots += [a] if a == b else [a, b]
        values += [v] if a == b else [v, v]
    return np.asarray(knots), np.asarray(values)


def calibrated(scores: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(scores, knots, values), 0.0, 1.0)
