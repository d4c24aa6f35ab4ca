"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised and mapped to cosines that approximate a Gaussian
kernel. Normal equations are summed within partitions and then on the driver; their size
is that of the feature map squared, whatever the rows. As they add up, leaving a fold out
is a subtraction, which gives the out-of-fold scores that the calibration needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_slices, materialize
from palimpsest.llm.labelled import calibrated, id_remainder, isotonic, isotonic_of, training_rows
from palimpsest.llm.wordhash import as_bytes, hash_words

N_COSINES, RIDGE, FOLDS, SEED = 256, 1e-3, 5, 20240229
#: Widths of the kernel, in standard deviations of a statistic times the root of their number.
WIDTHS = (0.35, 1.0)
#: Partitions that the training rows are summed in; each sends the driver its sums, of a fixed size.
TRAIN_PARTITIONS = 8
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0

_STATISTICS = ("log_bytes", "log_words", "word_bytes", "word_bytes_sd", "letters", "upper", "digits", "stops", "symbols", "spaces", "newlines", "bars", "distinct_words", "top_word", "short_words", "repeated_lines", "line_bytes", "shouts")


def _class_table() -> np.ndarray:
    """Which of eight classes each byte counts for."""
    table = np.zeros((8, 256), bool)
    letters = [*range(65, 91), *range(97, 123), *range(128, 256)]
    table[0, letters] = True
    table[1, 65:91] = True
    table[2, 48:58] = True
    table[3, list(b".,;:'\"?-()")] = True
    table[4, list(b"#$%&*@~^<>=+_/\\{}[]`")] = True
    table[5, list(b" \t\n\x0b\x0c\r")] = True
    table[6, 10] = True
    table[7, ord("|")] = True
    return table


_CLASSES = _class_table()


def statistics(texts) -> np.ndarray:
    """One row of document statistics for each text; an empty text has zeros but no gaps."""
    out = np.zeros((len(texts), len(_STATISTICS)))
    data = [as_bytes(t) for t in texts]
    words = hash_words(texts)
    counts = words.counts()
    for i, raw in enumerate(data):
        n = len(raw)
        out[i, 0], out[i, 1] = np.log1p(n), np.log1p(counts[i])
        if not n:
            continue
        histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        share = _CLASSES @ histogram / n
        out[i, 4], out[i, 6:12] = share[0], share[2:]
        out[i, 5] = share[1] / max(share[0], 1 / n)
        out[i, 17] = histogram[33] / n
        lines = raw.split(b"\n")
        out[i, 15], out[i, 16] = 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines))
        if not counts[i]:
            continue
        own = np.sort(words.hashes[words.first[i] : words.first[i + 1]])
        runs = np.diff(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])))
        out[i, 12], out[i, 13] = len(runs) / counts[i], runs.max() / counts[i]
        inside = np.concatenate([[False], ~_CLASSES[5][np.frombuffer(raw, np.uint8)], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        sizes = edges[1::2] - edges[::2]
        out[i, 2], out[i, 3], out[i, 14] = np.log1p(sizes.mean()), np.log1p(sizes.std()), (sizes <= 3).mean()
    return out


def _directions(p: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    width = np.resize(np.asarray(WIDTHS), N_COSINES) * np.sqrt(p)
    return rng.standard_normal((p, N_COSINES)) / width, rng.uniform(0, 2 * np.pi, N_COSINES)


@dataclass
class QualityModel:
    """Everything that scoring needs; about 60 kB whatever was fitted."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -4, 4)
        directions, phases = _directions(x.shape[1])
        return np.hstack([np.sqrt(2 / N_COSINES) * np.cos(x @ directions + phases), x / np.sqrt(x.shape[1]), np.ones((len(x), 1))])

    def score(self, texts) -> np.ndarray:
        return calibrated(self.map(statistics(texts)) @ self.weights, self.knots, self.values)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int | None = None) -> QualityModel:
    """Fit on labelled documents outside the held-out remainder; without any, every score is 0.5."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in bounded_slices(batch, rows=1024):
                yield pd.DataFrame({"doc_id": part["doc_id"], "x": list(statistics(part["text"].tolist()))})

    rows = training_rows(docs, labels, "quality", MODULUS, HELD_OUT, max_rows, described=describe)
    fold = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    table = materialize(rows.select("y", fold, "x").repartition(TRAIN_PARTITIONS), "quality_train")
    p = len(_STATISTICS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, p))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"])
                total += [np.full(p, len(x)), x.sum(0), (x**2).sum(0)]
        yield pd.DataFrame({"sums": [total.ravel()]})

    n, first, second = sum((np.asarray(r.sums).reshape(3, p) for r in table.mapInPandas(moments, "sums array<double>").collect()), np.zeros((3, p)))
    mean = first / np.maximum(n, 1)
    scale = np.sqrt(np.maximum(second / np.maximum(n, 1) - mean**2, 0))
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(0), np.zeros(0), np.zeros(0))
    size = N_COSINES + p + 1
    if n[0] == 0:
        model.weights, (model.knots, model.values) = np.zeros(size), isotonic(np.zeros(0), np.zeros(0))
        return model

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, cross = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                z = model.map(np.stack(part["x"]))
                gram[fold] += z.T @ z
                cross[fold] += z.T @ part["y"].to_numpy()
        for fold in range(FOLDS):
            yield pd.DataFrame({"fold": [fold], "gram": [gram[fold].tobytes()], "cross": [cross[fold].tobytes()]})

    grams, crosses = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for row in table.mapInPandas(equations, "fold int, gram binary, cross binary").collect():
        grams[row.fold] += np.frombuffer(row.gram).reshape(size, size)
        crosses[row.fold] += np.frombuffer(row.cross)

    def solve(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
        # the constant goes unpenalised: far from all training rows the score is the mean
        penalty = np.append(np.ones(size - 1), 1e-9)
        return np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1) * np.diag(penalty), cross)

    model.weights = solve(grams.sum(0), crosses.sum(0))
    by_fold = np.stack([solve(grams.sum(0) - grams[k], crosses.sum(0) - crosses[k]) for k in range(FOLDS)])

    def outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = model.map(np.stack(batch["x"]))
                yield pd.DataFrame({"s": np.einsum("ij,ij->i", z, by_fold[batch["fold"].to_numpy()]), "y": batch["y"]})

    model.knots, model.values = isotonic_of(table.mapInPandas(outside, "s double, y double"))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, into: str = "_quality") -> DataFrame:
    """All columns of ``docs`` and ``into``, the calibrated score of the whole text, which replaces a column of that name.

    Scores depend on the text alone; a null text counts as empty and is scored too.
    Labels without a document, null labels and documents without a label are no
    training rows; a document with several labels counts with their mean. Repeated
    rows and null ids are scored like any other row; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs, labels, max_rows))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [shared.value.score(texts.iloc[i : i + 1024].tolist()) for i in range(0, len(texts), 1024)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(into, score(F.col("text").cast("string")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id",
        (id_remainder("doc_id", MODULUS) == HELD_OUT).alias("held_out"),
        F.col("_quality").alias("score"),
        (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
