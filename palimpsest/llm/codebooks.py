"""Vector code compression: product codebooks refined by distributed integer sums.

Vectors are integers from the start, so every sum and every tie is exact, whatever the
order in which executors add. Each round broadcasts one kd-tree for each codebook; tasks
look up the nearest entry of all their parts at once and return sums of what each entry
got, which Spark adds up before the driver divides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, materialize

PARTS, ENTRIES, ROUNDS, SCALE_BITS = 8, 16, 6, 12
#: Entries in a leaf of a tree.
LEAF = 2
#: Sums travel in limbs of this base, so no sum of any finite vectors overflows.
BASE = 10**18


class Node(NamedTuple):
    """A box around some entries of a codebook: two children, or the entries' indexes."""

    low: np.ndarray
    high: np.ndarray
    left: Node | None
    right: Node | None
    own: list[int]


def kd_tree(entries: np.ndarray, own: list[int] | None = None) -> Node:
    """Halves entries across the widest side of their box until few are left."""
    own = list(range(len(entries))) if own is None else own
    low, high = entries[own].min(axis=0), entries[own].max(axis=0)
    if len(own) <= LEAF or not (high > low).any():
        return Node(low, high, None, None, own)
    side = int(np.argmax(high - low))
    own = sorted(own, key=lambda i: (entries[i][side], i))
    half = len(own) // 2
    return Node(low, high, kd_tree(entries, own[:half]), kd_tree(entries, own[half:]), [])


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry; the lower index wins ties.

    Branch and bound over all points at once: a box is visited by the points whose
    distance to it does not exceed their best so far. Equal bounds are visited too, since
    an entry of the same distance and a lower index may lie there.
    """
    index = np.zeros(len(points), np.int64)
    best = ((points - entries[0]) ** 2).sum(axis=1)

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        inside = np.minimum(np.maximum(points[rows], node.low), node.high)
        return ((points[rows] - inside) ** 2).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.left is None:
            for i in node.own:
                far = ((points[rows] - entries[i]) ** 2).sum(axis=1)
                better = np.asarray((far < best[rows]) | ((far == best[rows]) & (i < index[rows])), bool)
                index[rows[better]], best[rows[better]] = i, far[better]
            return
        left, right = bound(node.left, rows), bound(node.right, rows)
        near_left = np.asarray(left <= right, bool)
        visit(node.left, rows[near_left])
        visit(node.right, rows[~near_left])
        for child, limit, todo in ((node.right, right, near_left), (node.left, left, ~near_left)):
            open_still = todo & np.asarray(limit <= best[rows], bool)
            visit(child, rows[open_still])

    visit(tree, np.arange(len(points)))
    return index, best


def _floor_scaled(x: float) -> int:
    return int(x) << SCALE_BITS if abs(x) >= 2**53 else math.floor(math.ldexp(x, SCALE_BITS))


def integers(vectors: list[np.ndarray], width: int, limit: int) -> np.ndarray:
    """floor(4096 x) of each component, shorter vectors padded with zeros to PARTS * width.

    64-bit numbers where all are below ``limit``, Python's own otherwise.
    """
    out = np.zeros((len(vectors), PARTS * width), np.float64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    if np.abs(out).max(initial=0.0) < limit / 2 ** (SCALE_BITS + 1):
        return np.floor(np.ldexp(out, SCALE_BITS)).astype(np.int64)
    return np.asarray([[_floor_scaled(x) for x in row] for row in out.tolist()], object).reshape(out.shape)


class Codebooks:
    """The entries of all part positions with their trees; what a round broadcasts."""

    def __init__(self, entries: list[list[list[int]]], width: int) -> None:
        self.width = width
        #: Components below this have squared distances within 64 bits.
        self.limit = math.isqrt(2**62 // (PARTS * max(width, 1))) // 2
        largest = max((abs(x) for book in entries for e in book for x in e), default=0)
        self.books = [np.asarray(book, np.int64 if largest < self.limit else object).reshape(len(book), width) for book in entries]
        self.trees = [kd_tree(book) for book in self.books]

    def assigned(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows by parts), summed distances, and the integer components."""
        points = integers(vectors, self.width, self.limit)
        codes, errors = [], 0
        for part, (book, tree) in enumerate(zip(self.books, self.trees, strict=True)):
            own = points[:, part * self.width : (part + 1) * self.width]
            if book.dtype != own.dtype:
                book, own = book.astype(object), own.astype(object)
            code, error = nearest(tree, book, own)
            codes.append(code)
            errors = errors + error
        return np.stack(codes, axis=1), errors, points

    def text(self) -> str:
        return ",".join(str(x) for book in self.books for e in book.tolist() for x in e)


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        value, low = divmod(value, BASE)
        yield limb, sign * low
        limb += 1


def _refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts nearest to it."""
    sc = vectors.sparkSession.sparkContext
    sent, width, entries = sc.broadcast(books), books.width, len(books.books[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, total = sent.value, np.zeros((PARTS, entries, width + 1), object)
        for batch in batches:
            codes, _, points = books.assigned(list(batch["v"]))
            for part in range(PARTS):
                own = points[:, part * width : (part + 1) * width]
                for entry in np.unique(codes[:, part]).tolist():
                    mine = codes[:, part] == entry
                    # 64-bit components stay below 2**30, so a batch's sum fits
                    total[part, entry, :width] += own[mine].sum(axis=0).astype(object)
                    total[part, entry, width] += int(mine.sum())
        rows = [(slot, limb, value) for slot, number in enumerate(total.ravel().tolist()) for limb, value in _limbs(int(number))]
        yield pd.DataFrame(rows, columns=["slot", "limb", "value"])

    added = vectors.mapInPandas(sums, "slot long, limb int, value long").groupBy("slot", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    total = [0] * (PARTS * entries * (width + 1))
    for slot, limb, value in added.collect():  # at most a row for each number of the codebooks and limb
        total[slot] += int(value) * BASE**limb
    sent.unpersist()
    found = []
    for part, book in enumerate(books.books):
        rows = []
        for entry, old in enumerate(book.tolist()):
            at = (part * entries + entry) * (width + 1)
            *own, count = total[at : at + width + 1]
            rows.append([x // count for x in own] if count else old)
        found.append(rows)
    return Codebooks(found, width)


def compress(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Codes of all vectors: vec_id, code, error, label_error, codebooks_sha256, label.

    Takes vec_id, label and embedding; other columns are ignored. Vectors that are null
    or hold null or non-finite components are dropped, zero vectors are kept. Codebooks
    start from the ``entries`` smallest vec_ids (equal ids by their components, null ids
    last), or from all vectors where there are fewer. Vectors of unequal length, or of one
    that 8 does not divide, count as padded with zeros. Repeated ids are rows of their
    own. Components of any finite size are exact; an error that no 64-bit integer holds
    is null, and so is the label_error of its label. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")))
    width = -(-(vectors.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    limit = math.isqrt(2**62 // (PARTS * max(width, 1))) // 2
    start = integers([np.asarray(r.v, np.float64) for r in first], width, limit)
    books = Codebooks([[v[p * width : (p + 1) * width] for v in start.tolist()] for p in range(PARTS)], width) if first else None
    for _ in range(rounds if books else 0):
        books = _refined(vectors, books)
    sent = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes, errors, _ = sent.value.assigned(list(batch["v"]))
                yield pd.DataFrame(
                    {
                        "vec_id": batch["vec_id"].astype("Int64"),
                        "row_label": batch["row_label"],
                        "code": [row.tobytes().hex() for row in codes.astype(np.uint8)],
                        "error": pd.array([e if e < 2**63 else None for e in errors.tolist()], dtype="Int64"),
                    }
                )

    kind = vectors.schema["label"].dataType.simpleString()
    # texts carry labels of any type, null included, through Python
    final = materialize(
        vectors.select("vec_id", F.col("label").cast("string").alias("row_label"), "v").mapInPandas(coded, "vec_id long, row_label string, code string, error long"),
        "codes",
    )
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = final.groupBy(F.col("row_label").alias("of_label")).agg(F.when(F.count("error") == F.count(F.lit(1)), whole).alias("sum")).select("of_label", F.expr("try_cast(sum AS bigint)").alias("label_error"))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    return final.join(by_label, F.col("row_label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), F.col("row_label").cast(kind).alias("label")
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row of ``embeddings``."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The same rounds one after the other, every distance computed."""
    square = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for r in range(1, ROUNDS + 2):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, any_value(x) AS x, min(struct_pack(d := {square}, k := k)) AS best
  FROM parts JOIN c{r - 1} USING (p) GROUP BY vec_id, label, p)""")
        if r <= ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT p, k, pos, sum(v)::BIGINT AS s, count(*) AS n
  FROM (SELECT p, best.k AS k, unnest(range(len(x))) AS pos, unnest(x) AS v FROM a{r}) GROUP BY p, k, pos),
c{r} AS MATERIALIZED (
  SELECT c.p, c.k, coalesce(f.e, c.e) AS e FROM c{r - 1} c LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM m{r} GROUP BY p, k) f USING (p, k))""")
    last = ROUNDS + 1
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, k, x AS e FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM parts) WHERE k < {ENTRIES}),
{", ".join(steps)},
done AS (SELECT vec_id, label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256, label FROM done, digest"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE_SQL = {"op11_vector_codes": _oracle()}
