"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

A filter direction is a pair of unit codewords, one for each half of the coordinates, so
a few hundred codewords stand for many thousand directions. A vector passes a filter if
it lies within the cap around its direction; the list of filters that it passes is found
by branch and bound over the halves. Vectors that share a label and a filter are compared
exactly, and a pair that meets several times counts in the first group of filters alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import connected_components, materialize

THRESHOLD = 0.93
#: Filters that a random vector passes on average, and least filters of any vector: where
#: fewer caps hold a vector, its caps widen until enough do. Two vectors at the threshold
#: then share twenty filters in the mean; of 2,000 such pairs none shared fewer than one.
EXPECTED_FILTERS, MIN_FILTERS, WIDEN = 28, 28, 0.02
#: Neighbouring filters (one first half) that are compared together, which moves a vector
#: once for them all.
GROUP = 64
#: Vectors of one label that a filter holds on average; more directions are used for more vectors.
EXPECTED_MEMBERS = 16
#: Largest share of the sphere that a cap may cover.
MAX_CAP = 0.01
#: Vectors compared in one block. Larger filters are split into blocks that tasks share.
BLOCK = 1024
#: Below this many coordinates caps tell nothing apart; a label is then one filter, compared in blocks.
MIN_DIMENSIONS = 16
SEED = 7919


def cap_parameters(n_label: int, dimensions: int) -> tuple[int, float]:
    """Codewords for each half and the cosine of the cap, for labels of up to ``n_label`` vectors."""
    cap = min(MAX_CAP, EXPECTED_MEMBERS / max(n_label, 1))
    return math.ceil(math.sqrt(EXPECTED_FILTERS / cap)), NormalDist().inv_cdf(1 - cap) / math.sqrt(dimensions)


@cache
def codewords(dimensions: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimensions, n])
    halves = []
    for size in (dimensions // 2, dimensions - dimensions // 2):
        words = rng.standard_normal((n, size))
        halves.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return halves[0], halves[1]


def list_decode(unit: np.ndarray, n: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter direction within the cap of each unit vector."""
    rows_found, filters = [], []
    left, right = codewords(unit.shape[1], n)
    half, bound = unit.shape[1] // 2, cap * math.sqrt(2)
    for start in range(0, len(unit), 256):
        x = unit[start : start + 256]
        a, b = x[:, :half] @ left.T, x[:, half:] @ right.T
        # first halves that the best second half can still lift over the bound
        row, first = np.nonzero(a + b.max(1, keepdims=True) >= bound)
        for at in range(0, len(row), 8192):
            r, f = row[at : at + 8192], first[at : at + 8192]
            hit, second = np.nonzero(b[r] + a[r, f][:, None] >= bound)
            rows_found.append(start + r[hit])
            filters.append(f[hit] * n + second)
    if not rows_found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, found = np.concatenate(rows_found), np.concatenate(filters)
    order = np.lexsort((found, row))
    return row[order], found[order]


def passed_filters(unit: np.ndarray, n: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every vector, by row, with caps widened for vectors that few hold."""
    rows, filters, left = [], [], np.arange(len(unit))
    while len(left):
        row, found = list_decode(unit[left], n, cap)
        enough = (np.bincount(row, minlength=len(left)) >= min(MIN_FILTERS, n * n)) | (cap < -1)
        use = enough[row]
        rows.append(left[row[use]])
        filters.append(found[use])
        left, cap = left[~enough], cap - WIDEN
    row, found = np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*filters, np.zeros(0, np.int64)])
    order = np.lexsort((found, row))
    return row[order].astype(np.int64), found[order].astype(np.int64)


def filter_groups(unit: np.ndarray, n: int, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, group) without repeats: the groups of the filters that each vector passes."""
    row, found = passed_filters(unit, n, cap)
    per_half = math.ceil(n / GROUP)
    group = (found // n) * per_half + (found % n) // GROUP
    use = np.ones(len(row), bool)
    use[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
    return row[use], group[use]


def level(x: np.ndarray) -> np.ndarray:
    """Rows of doubles over a power of two each, so that no square over- or underflows; nothing is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


ROUTE_SCHEMA = "label long, dims int, filter long, k1 long, k2 long, id long, copies long, v binary, passed binary"
OUT_SCHEMA = "kind int, k1 long, k2 long, a long, b long"


def _keyed(vectors: DataFrame) -> DataFrame:
    wide = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & wide.isNotNull() & (F.size(wide) > 0)
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(wide, lambda x: x != 0)
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding"),
        F.coalesce(good & finite & some, F.lit(False)).alias("valid"),
        F.xxhash64(F.lit(1), "label", "embedding").alias("k1"),
        F.xxhash64(F.lit(2), "label", "embedding").alias("k2"),
    )


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Number of links and component of each vector.

    Takes ``vec_id``, ``embedding`` and ``label``; other columns are ignored. Two
    vectors are linked if their labels are equal and not null, their dimensions are
    equal and their cosine in double precision is at least ``threshold``. A vector
    that is null, empty, zero or holds a null or non-finite component is linked with
    nothing. Returns vec_id, n_links, component_id (smallest linked id, directly or
    not) and kept (whether that is the vector's own). Repeated rows are vectors of
    their own and so link. A null vec_id links and counts, but has a null component
    and kept is null. Equal vectors are compared once, whatever their number. An empty
    table gives an empty one.
    """
    rows = _keyed(vectors)
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    reps = materialize(rows.filter("valid").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "vectors")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["embedding"].map(len)
            for d, part in batch.groupby(dims):
                raw = np.stack(part["embedding"].to_numpy()).astype(kind)
                wide = level(raw.astype(np.float64))
                unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
                if d < MIN_DIMENSIONS:
                    row, found = np.arange(len(part)), np.zeros(len(part), np.int64)
                else:
                    row, found = filter_groups(unit, *cap_parameters(largest, d))
                first = np.searchsorted(row, np.arange(len(part) + 1))
                part = part.reset_index(drop=True)
                whole = [v.tobytes() for v in raw]
                passed = [found[first[i] : first[i + 1]].astype("<i8").tobytes() for i in range(len(part))]
                for at in range(0, len(row), 20_000):
                    r = row[at : at + 20_000]
                    out = part.loc[r, ["label", "k1", "k2", "id", "copies"]].reset_index(drop=True)
                    # only the groups before its own decide where a pair counts
                    before = 8 * (np.arange(at, at + len(r)) - first[r])
                    yield out.assign(dims=d, filter=found[at : at + 20_000], v=[whole[i] for i in r], passed=[passed[i][:n] for i, n in zip(r, before, strict=True)])[["label", "dims", "filter", "k1", "k2", "id", "copies", "v", "passed"]]

    bucket = ["label", "dims", "filter"]
    routes = reps.mapInPandas(route, ROUTE_SCHEMA)
    crowded = materialize(routes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "crowded")
    part = F.pmod(F.xxhash64(F.lit(5), "k1", "k2"), F.col("parts")).cast("int")
    dealt = (
        routes.join(crowded, bucket, "left")
        .withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(BLOCK)))
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        .select(*bucket, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "k1", "k2", "id", "copies", "v", "passed")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block; a block is held until the next begins."""
        keys = [*bucket, "lo", "hi"]
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = rows[keys].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
            out = [found for a, b in zip(starts, starts[1:], strict=False) if b - a > 1 and (found := _compare_block(rows.iloc[a:b], kind, threshold)) is not None]
            if out:
                yield pd.concat(out)
            held = rows.iloc[starts[-1] :]
        if held is not None and len(held) > 1 and (found := _compare_block(held, kind, threshold)) is not None:
            yield found

    blocks = dealt.repartition(*bucket, "lo", "hi").sortWithinPartitions(*bucket, "lo", "hi")
    found = materialize(blocks.mapInPandas(compare, OUT_SCHEMA), "links")
    links = found.filter("kind = 0").groupBy("k1", "k2").agg(F.sum("a").alias("links"))
    copies = reps.select("k1", "k2", "copies", F.col("id").alias("rep"))
    known = materialize(copies.join(links, ["k1", "k2"], "left").select("k1", "k2", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    told = rows.drop("embedding", "label").join(known, ["k1", "k2"], "left")
    own = told.filter("valid").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    joined = connected_components(found.filter("kind = 1").select("a", "b").unionByName(own))
    return (
        told.select("vec_id", F.when(F.col("valid"), F.col("n_links")).alias("n_links"))
        .join(joined, F.col("vec_id") == F.col("node"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"))
    )


def _compare_block(block: pd.DataFrame, kind: str, threshold: float) -> pd.DataFrame | None:
    """Links of one block: a count for each vector, and a star of ids for each component."""
    x = level(np.frombuffer(b"".join(block["v"]), kind).reshape(len(block), -1).astype(np.float64))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    part, lo, hi = block["part"].to_numpy(), block["lo"].iloc[0], block["hi"].iloc[0]
    if lo != hi:
        near &= part[:, None] != part[None, :]
    np.fill_diagonal(near, False)
    if not near.any():
        return None
    # a pair counts here only if it meets in no group before this one
    smaller = [np.frombuffer(p, "<i8") for p in block["passed"]]
    which, column = np.unique(np.concatenate(smaller), return_inverse=True) if smaller else (np.zeros(0), np.zeros(0))
    if len(which):
        marks = np.zeros((len(block), len(which)), np.float32)
        marks[np.repeat(np.arange(len(block)), [len(s) for s in smaller]), column] = 1
        first_here = near & ((marks @ marks.T) == 0)
    else:
        first_here = near
    copies = block["copies"].to_numpy(np.int64)
    counts = first_here @ copies
    ids = block["id"].to_numpy(dtype=object)
    stars_a, stars_b = [], []
    waiting = np.ones(len(block), bool)
    for i in np.flatnonzero(near.any(1)):
        if not waiting[i]:
            continue
        members, frontier = [i], [i]
        waiting[i] = False
        while frontier:
            reached = np.flatnonzero(near[frontier].any(0) & waiting)
            waiting[reached] = False
            members.extend(reached)
            frontier = list(reached)
        named = [int(ids[m]) for m in members if not pd.isna(ids[m])]
        stars_a += [m for m in named if m != min(named)]
        stars_b += [min(named)] * (len(stars_a) - len(stars_b))
    n = np.flatnonzero(counts)
    zero = np.zeros(len(stars_a), np.int64)
    return pd.concat([
        pd.DataFrame({"kind": 0, "k1": block["k1"].to_numpy()[n], "k2": block["k2"].to_numpy()[n], "a": counts[n], "b": np.zeros(len(n), np.int64)}),
        pd.DataFrame({"kind": 1, "k1": zero, "k2": zero, "a": np.asarray(stars_a, np.int64), "b": np.asarray(stars_b, np.int64)}),
    ])


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every embedding within its label."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_embedding_neardup": op1_embedding_neardup}
ORACLE_SQL = {
    "op1_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
}
