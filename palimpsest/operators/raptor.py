"""Hierarchical clustering of leaves: reduction, mixtures, soft DAG, manifests.

Numeric kernels are numpy on one cluster's bounded members inside a grouped map; the loop
over levels is on the driver and ends after at most ten.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.identity import Xoshiro, canonical_json, sha256_hex
from palimpsest.sources.shared import written

MAX_CLUSTERS, MAX_ROUNDS, TOLERANCE, FLOOR = 50, 100, 1e-4, 1e-6


#: Shape of the low-dimensional affinity for a least distance of 0.1 and a spread of 1.
CURVE_A, CURVE_B = 1.5769434602, 0.8950608779
EPOCHS, NEGATIVES = 200, 5


def reduce_dimensions(x: np.ndarray, components: int, neighbours: int = 15, seed: str = "tree", scope: str = "global") -> np.ndarray:
    """A neighbour embedding: nearby rows stay near, in few dimensions; the seed fixes every bit.

    Columns that do not vary go. No rows give none, one gives 0, two give their ends of a
    line, and equal rows zeros. Each row's nearest neighbours get affinities that fall with
    distance at a width of its own; they are joined by fuzzy union, and rows attract along
    them and repel rows at random, starting from the principal components.
    """
    n = len(x)
    if n <= 1:
        return np.zeros((n, 1))
    x = x[:, x.var(0) > 1e-12]
    size = max(1, min(components, n - 2, x.shape[1])) if n > 2 else 1
    if x.shape[1] == 0:
        return np.zeros((n, size))
    if n == 2:
        return np.asarray([[-0.5], [0.5]])
    k = max(2, min(neighbours, n - 1))
    gap = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) if n <= 256 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(gap, 0)
    near = np.argsort(gap, axis=1, kind="stable")[:, :k]
    reach = np.take_along_axis(gap, near, 1)
    closest = np.where(reach > 0, reach, np.inf).min(1)
    closest = np.where(np.isfinite(closest), closest, 0)[:, None]
    low, high, width = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(64):  # the width at which a row's affinities sum to log2 of their number
        total = np.exp(-np.maximum(reach[:, 1:] - closest, 0) / width[:, None]).sum(1)
        wide = total > np.log2(k)
        high, low = np.where(wide, width, high), np.where(wide, low, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    width = np.maximum(width, 1e-3 * np.maximum(reach.mean(1), 1e-12))
    affinity = np.zeros((n, n))
    np.put_along_axis(affinity, near, np.exp(-np.maximum(reach - closest, 0) / width[:, None]), 1)
    np.fill_diagonal(affinity, 0)
    affinity = affinity + affinity.T - affinity * affinity.T
    a, b = np.nonzero(affinity > affinity.max() / EPOCHS)
    weight = affinity[a, b] / affinity.max()
    centred = x - x.mean(0)
    v = np.linalg.svd(centred, full_matrices=False)[2][:size]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    y = centred @ v.T
    y = 10 * y / max(np.abs(y).max(), 1e-12)
    rng = np.random.default_rng(int(sha256_hex(f"{seed}:{scope}")[:16], 16))
    due = np.zeros(len(a))
    for epoch in range(EPOCHS):
        step = 1 - epoch / EPOCHS
        due += weight
        use = np.flatnonzero(due >= 1)
        due[use] -= 1
        i, j = a[use], b[use]
        apart = y[i] - y[j]
        square = (apart**2).sum(1, keepdims=True)
        pull = -2 * CURVE_A * CURVE_B * square ** (CURVE_B - 1) / (1 + CURVE_A * square**CURVE_B) if len(i) else square
        move = np.clip(np.where(square > 0, pull, 0) * apart, -4, 4) * step
        y = _moved(_moved(y, i, move), j, -move)
        i = np.repeat(i, NEGATIVES)
        j = rng.integers(0, n, len(i))
        apart = y[i] - y[j]
        square = (apart**2).sum(1, keepdims=True)
        push = 2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * square**CURVE_B))
        y = _moved(y, i, np.clip(push * apart, -4, 4) * step * (i != j)[:, None])
    return y


def _moved(y: np.ndarray, rows: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``y`` with all moves of its rows added in their order, to the bit as ``np.add.at`` would, and faster."""
    at = np.concatenate([np.arange(len(y)), rows])
    return np.stack([np.bincount(at, np.concatenate([y[:, c], moves[:, c]]), len(y)) for c in range(y.shape[1])], 1)


def fit_mixture(x: np.ndarray, k: int, seed: str) -> dict:
    """A diagonal Gaussian mixture by expectation-maximisation from spread-out seeds."""
    rng, (n, d) = Xoshiro(seed), x.shape
    scale = x.std(0)
    x = (x - x.mean(0)) / np.where(scale > 0, scale, 1)
    centres = [x[rng.below(n)]]
    gap = np.full(n, np.inf)
    while len(centres) < k:
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(1))
        at = rng.uniform() * gap.sum()
        centres.append(x[min(int(np.searchsorted(np.cumsum(gap), at)), n - 1)])
    means, variances, weights, square = np.asarray(centres), np.ones((k, d)), np.full(k, 1 / k), x**2
    last = -np.inf
    for _ in range(MAX_ROUNDS):
        # the squared distances multiplied out: no array of rows, components and columns
        gap = square @ (1 / variances).T - 2 * x @ (means / variances).T + (means**2 / variances).sum(1)
        log = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(1) + np.maximum(gap, 0))
        top = log.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(1))
        share = np.exp(log - total[:, None])
        likelihood = float(total.sum())
        mass = share.sum(0)
        if (mass < 1e-9).any():
            raise ValueError("a component collapsed")
        if abs(likelihood - last) < TOLERANCE:
            break
        last = likelihood
        weights, means = mass / n, (share.T @ x) / mass[:, None]
        variances = np.maximum((share.T @ square) / mass[:, None] - means**2, FLOOR)
    parameters = k * 2 * d + k - 1
    return {"shares": share, "likelihood": likelihood, "parameters": parameters, "bic": -2 * likelihood + parameters * float(np.log(n))}


def best_mixture(x: np.ndarray, most: int, seed: str) -> dict:
    """The mixture with the least BIC; the first of equals, and sizes that collapse are passed over."""
    best = {"shares": np.ones((len(x), 1)), "bic": np.inf}
    for k in range(1, max(1, min(most, MAX_CLUSTERS, len(x) - 1)) + 1):
        try:
            fit = fit_mixture(x, k, f"{seed}:{k}")
        except ValueError:
            continue
        if fit["bic"] < best["bic"]:
            best = fit
    return best


def soft_clusters(shares: np.ndarray, threshold: float = 0.1) -> list[tuple[int, ...]]:
    """Members of each cluster: share over the threshold, or the largest; equal clusters once."""
    hold = shares >= threshold
    hold[np.arange(len(shares)), shares.argmax(1)] = True
    return sorted({tuple(np.flatnonzero(c).tolist()) for c in hold.T if c.any()})


def token_partition(items: list[tuple[str, int]], budget: int) -> list[list[str]]:
    """Groups by id within a token budget; an item at or over it closes its group."""
    groups, now, used = [], [], 0
    for name, size in sorted(items):
        if now and used + size > budget:
            groups.append(now)
            now, used = [], 0
        now.append(name)
        used += size
        if size >= budget:
            groups.append(now)
            now, used = [], 0
    return groups + [now] if now else groups


def _within(budget: int | None, ids: list[str], tokens: list[int]) -> list[list[str]]:
    """One group of ids, or its parts where it exceeds the token budget."""
    return [ids] if budget is None or sum(tokens) <= budget else token_partition(list(zip(ids, tokens, strict=True)), budget)


def _rough(vectors: DataFrame, group: str, components: int, most: int, threshold: float, budget: int | None, seed: str) -> DataFrame:
    """First step, a task a part of a group: (grp, part, first, id, vector, tokens, size), a row for each rough cluster of an id.

    ``first`` numbers the clusters of a part. A part needs no clusters, and is one, where it
    has two members at most, or where no two of its members fit the budget together; in
    the latter case each member is one.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        n = len(rows)
        apart = budget is not None and n > 1 and rows["tokens"].nsmallest(2).sum() > budget
        if apart:
            clusters = [(i,) for i in range(n)]
        elif n < 3:
            clusters = [tuple(range(n))]
        else:
            x = np.stack(rows["vector"].to_numpy()).astype(float)
            near = max(2, min(n - 1, math.ceil(math.sqrt(n))))
            own = f"{seed}:{key[0]}:{key[1]}"
            clusters = soft_clusters(best_mixture(reduce_dimensions(x, components, near, own, "global"), most, f"{own}:global")["shares"], threshold)
        taken = pd.concat([rows.iloc[list(c)].assign(first=k) for k, c in enumerate(clusters)])
        return taken.assign(grp=key[0], part=key[1], size=n)[["grp", "part", "first", "id", "vector", "tokens", "size"]]

    return vectors.groupBy(group, "part").applyInPandas(run, "grp long, part int, first int, id string, vector array<double>, tokens long, size long")


def _fine(rough: DataFrame, components: int, neighbours: int, most: int, threshold: float, seed: str) -> DataFrame:
    """Second step, a task a rough cluster: (grp, part, size, members) of the soft clusters within it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].tolist()
        found: list[tuple[int, ...]] = [tuple(range(len(ids)))]
        if len(ids) >= 3:
            x = np.stack(rows["vector"].to_numpy()).astype(float)
            own = f"{seed}:{key[0]}:{key[1]}:local:{','.join(ids)}"
            found = soft_clusters(best_mixture(reduce_dimensions(x, components, neighbours, own, "local"), most, own)["shares"], threshold)
        return pd.DataFrame({"grp": key[0], "part": key[1], "size": int(rows["size"].iloc[0]), "members": [[ids[i] for i in g] for g in found]})

    return rough.groupBy("grp", "part", "first").applyInPandas(run, "grp long, part int, size long, members array<string>")


def cluster_groups(vectors: DataFrame, group: str, components: int = 10, neighbours: int = 10, most: int = MAX_CLUSTERS, seed: str = "tree", threshold: float = 0.1, max_group: int = 2048, budget: int | None = None) -> DataFrame:
    """Soft clusters within each group: (grp, cluster, member, tokens).

    Clusters are learned for all of a group and again within each, the second step dealt
    anew, so that one group's rough clusters are worked on side by side. Where a fine cluster is
    all of its group, the group stays whole. A cluster over the token budget is split into
    runs of ids that keep it, and a member alone is a cluster of its own, under its own
    id. A group larger than ``max_group`` is split by a hash of the id first, so that a
    task holds a bounded number of vectors and their distances: members of different parts
    then meet a level higher only.
    """
    sizes = vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / max_group).alias("parts"))
    split = vectors.join(sizes, group).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rough = written(_rough(split.withColumn("vector", F.col("vector").cast("array<double>")), group, components, most, threshold, budget, seed), "rough")
    fine = _fine(rough, components, neighbours, most, threshold, seed).dropDuplicates(["grp", "part", "members"])
    # a cluster that is all of its part makes the others of no use
    whole = fine.withColumn("all", F.size("members") == F.col("size")).withColumn("any_all", F.max("all").over(Window.partitionBy("grp", "part"))).filter("all OR NOT any_all")
    named = whole.select("grp", "part", F.sha2(F.array_join("members", "\x00"), 256).alias("c"), F.explode("members").alias("id"))
    weighed = named.join(rough.select("grp", "part", "id", "tokens").distinct(), ["grp", "part", "id"])

    def sized(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(rows["id"], rows["tokens"].astype(int), strict=True))
        parts = _within(budget, sorted(size), [size[i] for i in sorted(size)])
        out = [(key[0], p[0] if len(p) == 1 else sha256_hex(canonical_json({"members": p, "seed": seed})), m, size[m]) for p in parts for m in p]
        return pd.DataFrame(out, columns=["grp", "cluster", "member", "tokens"])

    return weighed.groupBy("grp", "c").applyInPandas(sized, "grp long, cluster string, member string, tokens long").dropDuplicates(["grp", "cluster", "member"])


def build_tree(vectors: DataFrame, budget: int, max_levels: int = 5, seed: str = "tree", **options) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level, tokens) and edges (parent, child, level), each edge one level up.

    A member alone is carried, without a parent. A group ends when at most one node is
    left, when no cluster has two, or when it carries a node, since a later parent would
    then skip a level; the tree ends with its last group or at ``max_levels``.
    """
    spark = vectors.sparkSession
    keep = lambda df: written(df, "tree")
    nodes = vectors.select("id", F.lit(0).alias("level"), "tokens")
    edges = spark.createDataFrame([], "parent string, child string, level int")
    now = vectors.select(F.col("grp"), "id", "vector", "tokens")
    for level in range(1, max_levels + 1):
        linked = keep(cluster_groups(now, "grp", seed=f"{seed}:{level}", budget=budget, **options))
        joined = linked.filter("cluster <> member")
        if joined.isEmpty():
            break
        means = joined.join(now.select(F.col("id").alias("member"), "vector"), "member").select("grp", "cluster", F.posexplode("vector").alias("place", "x")).groupBy("grp", "cluster", "place").agg(F.avg("x").alias("x"))
        up = means.groupBy("grp", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("vector"))
        sums = joined.groupBy("grp", "cluster").agg(F.sum("tokens").alias("tokens"))
        parents = keep(up.join(sums, ["grp", "cluster"]).select("grp", F.col("cluster").alias("id"), "vector", "tokens"))
        edges = edges.unionByName(joined.select(F.col("cluster").alias("parent"), F.col("member").alias("child"), F.lit(level).alias("level")))
        nodes = nodes.unionByName(parents.select("id", F.lit(level).alias("level"), "tokens"))
        carried = linked.filter("cluster = member").select("grp").distinct()
        several = parents.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("grp")
        now = parents.join(several, "grp", "left_semi").join(carried, "grp", "left_anti")
        if now.isEmpty():
            break
    return nodes, edges


def evidence_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, leaf): every leaf below each root, level by level, each pair once."""
    level = roots.select(F.col("id").alias("root"), F.col("id").alias("node"))
    leaves = None
    parents = edges.select(F.col("parent").alias("node")).distinct()
    for _ in range(10):
        ends = level.join(parents, "node", "left_anti").select("root", F.col("node").alias("leaf"))
        leaves = ends if leaves is None else leaves.unionByName(ends)
        level = level.join(edges.select(F.col("parent").alias("node"), "child"), "node").select("root", F.col("child").alias("node")).distinct()
    return leaves.distinct()


def merkle_root(hashes: list[str]) -> str:
    """Pairwise root of chunk hashes; an odd one out is paired with itself."""
    level = hashes or [sha256_hex("empty")]
    while len(level) > 1:
        level = [sha256_hex(canonical_json({"left": level[i], "right": level[min(i + 1, len(level) - 1)]})) for i in range(0, len(level), 2)]
    return level[0]


def merkle_column(hashes: Column, most: int = 64) -> Column:
    """``merkle_root`` of an array of at most ``most`` hashes, in built-in expressions."""

    def up(level: Column) -> Column:
        pair = lambda i: F.sha2(F.concat(F.lit('{"left":"'), F.element_at(level, i), F.lit('","right":"'), F.element_at(level, F.least(i + 1, F.size(level))), F.lit('"}')), 256)
        return F.transform(F.filter(F.sequence(F.lit(1), F.size(level)), lambda i: i % 2 == 1), pair)

    first = F.when(F.size(hashes) == 0, F.array(F.lit(sha256_hex("empty")))).otherwise(hashes)
    rounds = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(max(most, 2))))))
    # a fold, so that each level is named once in the plan
    return F.element_at(F.aggregate(rounds, first, lambda level, _: F.when(F.size(level) > 1, up(level)).otherwise(level)), 1)


def manifest_chunks(members: DataFrame, chunk: int = 1024) -> DataFrame:
    """Sorted members in chunks of ``chunk``, each with its content hash, by group."""
    return members.groupBy("grp", (F.floor((F.col("n") - 1) / chunk)).alias("chunk")).agg(F.count(F.lit(1)).alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("content_hash"))


def manifests(members: DataFrame, chunk: int = 1024) -> DataFrame:
    """A manifest for each group (grp, id): members counted and hashed by chunk, and the root over the chunks.

    Members are placed by a window on ids alone; a group has at most 65,536 of them.
    """
    placed = members.select("grp", "id").withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy("id")))
    chunks = manifest_chunks(placed, chunk)
    roots = chunks.groupBy("grp").agg(F.sum("size").alias("leaf_count"), F.array_sort(F.collect_list(F.struct("chunk", "content_hash"))).alias("c"))
    return roots.select("grp", "leaf_count", F.size("c").cast("long").alias("n_chunks"), merkle_column(F.col("c.content_hash")).alias("merkle_root"))


def verify_manifests(stored: DataFrame, members: DataFrame, chunk: int = 1024) -> DataFrame:
    """(grp, valid): whether each stored manifest is that of the members as they are; a missing side is invalid."""
    found = manifests(members, chunk).select("grp", F.struct("leaf_count", "n_chunks", "merkle_root").alias("now"))
    held = stored.select("grp", F.struct("leaf_count", "n_chunks", "merkle_root").alias("then"))
    return held.join(found, "grp", "full").select("grp", F.coalesce(F.col("now") == F.col("then"), F.lit(False)).alias("valid"))


def generation_ids(manifest: DataFrame, base: Column, epochs: Column, algorithm: str, model: str, job: Column, fence: Column) -> DataFrame:
    """The logical id of a generation, and that of this attempt at it: every fenced attempt has a namespace of its own."""
    core = F.sha2(F.concat_ws("|", F.lit("generation"), "merkle_root", F.col("leaf_count").cast("string"), F.coalesce(base, F.lit("-")), epochs, F.lit(algorithm), F.lit(model)), 256)
    return manifest.withColumn("generation_id", core).withColumn("attempt_id", F.sha2(F.concat_ws("|", F.lit("attempt"), "generation_id", job, fence.cast("string")), 256))
