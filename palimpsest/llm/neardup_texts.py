"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is summarised by registers that hold, on an
exponential scale, truncated minima of exponentially distributed hash times. Registers
of a union are the larger registers, so sketches merge, and equal registers are as
likely as sets are similar. Bands of registers propose pairs, a likelihood estimate from
all registers drops the hopeless ones, and full sets confirm the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, bounded_slices, connected_components, discard, free_name, materialize, materialize_alone
from palimpsest.llm.wordhash import gram_hashes, hash_words, mix

#: Words of a shingle.
SHINGLE = 5
#: Registers, base of their scale and rate of the exponential times.
REGISTERS, BASE, RATE = 120, 1.001, 20.0
#: Registers of a band. At similarity 0.85 all 24 bands differ with a chance below 1e-6.
BAND = 5
#: Pairs whose estimated similarity falls short of the threshold by more than this are
#: dropped before their texts are compared: five standard errors of the estimate.
MARGIN = 0.17
#: Least similarity of a link, in hundredths.
THRESHOLD = 85
#: Documents compared in one block, and shingles (distinct, and in all) counted at a time.
BLOCK, COLUMNS, ROOM = 512, 8192, 500_000
#: Ids that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = (1 << 16) - 1
SKETCH_SCHEMA = "doc_id long, th long, f1 long, f2 long, n long, regs binary"


def shingles(words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text of a ``Words``, sorted.

    A text of fewer words than a shingle has its whole sequence as the only one.
    """
    counts = words.counts()
    text = words.text_of_word()
    grams = gram_hashes(words.hashes, k)
    inside = text[: len(grams)] == text[k - 1 : k - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
    texts, hashes = [text[: len(grams)][inside]], [grams[inside]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = np.concatenate([gram_hashes(words.hashes[words.first[i] : words.first[i + 1]], n) for i in short])
            texts.append(short)
            hashes.append(mix(whole + np.uint64(n) * _STEP))
    text, found = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    use = np.ones(len(text), bool)
    use[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    return text[use], found[use]


def registers(text: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """SetSketch registers (n_texts, REGISTERS) of distinct hashes; 0 for an empty set.

    Every element sends arrivals of a Poisson process to random registers, which makes
    the first arrivals at different registers independent. Only arrivals before a time
    by which all registers of a set are almost surely hit are followed; where one is
    not, the time is doubled.
    """
    sizes = np.bincount(text, minlength=n_texts)
    first = np.full((n_texts, REGISTERS), np.inf)
    horizon = (math.log(REGISTERS) + 3.0) / np.maximum(sizes, 1)
    missing = sizes > 0
    while missing.any():
        use = missing[text]
        owner, element = text[use], hashes[use]
        first[missing] = np.inf
        at, k = np.zeros(len(owner)), 0
        while len(owner):
            k += 1
            draw = mix(element + np.uint64(k * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
            at = at - np.log(((draw >> np.uint64(12)).astype(np.float64) + 1.0) * 2.0**-52) / REGISTERS
            alive = at <= horizon[owner]
            owner, element, at, draw = owner[alive], element[alive], at[alive], draw[alive]
            register = (mix(draw) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(first.reshape(-1), owner * REGISTERS + register, at)
        horizon = np.where(missing, horizon * 2, horizon)
        missing &= np.isinf(first).any(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.floor(1 - np.log(first / RATE) / math.log(BASE))
    return np.where(np.isinf(first), 0, np.clip(level, 0, _LIMIT)).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def likely_similarity(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from sizes and registers, to one part in ``steps``."""
    total = (n_a + n_b).astype(float)
    u, v = (n_a / total)[:, None], (n_b / total)[:, None]
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = REGISTERS - above - below
    j = np.linspace(0, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p, q = chance(u - v * j), chance(v - u * j)
    tiny = 1e-12
    likelihood = above * np.log(p + tiny) + below * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, 0) + tiny)
    return np.take_along_axis(j, likelihood.argmax(1)[:, None], 1)[:, 0]


def sketch_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, th, f1, f2, n, regs) of each row: text hash, hashes of the word sequence, set size, registers."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in bounded_slices(batch):
                words = hash_words(part["text"], lower=True)
                text, found = shingles(words)
                place = np.arange(len(words.hashes), dtype=np.uint64) - np.repeat(words.first[:-1], words.counts()).astype(np.uint64)
                whole = []
                for salt in (1, 2):
                    # addition keeps order out, so the place is hashed in
                    term = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hashes + (place + np.uint64(salt << 40)) * _STEP), dtype=np.uint64)])
                    whole.append((term[words.first[1:]] - term[words.first[:-1]]).view(np.int64))
                regs = registers(text, found, len(part))
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "th": part["th"].array, "f1": whole[0], "f2": whole[1], "n": np.bincount(text, minlength=len(part)), "regs": [r.tobytes() for r in regs]})

    return _texts(docs).mapInPandas(sketch, SKETCH_SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _hopeful(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs (id, th, hid, hth) whose registers do not rule the threshold out."""
    other = reps.select(F.col("id").alias("hid"), F.col("th").alias("hth"), F.col("n").alias("hn"), F.col("regs").alias("hregs"))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), -1) for c in ("regs", "hregs"))
                near = likely_similarity(batch["n"].to_numpy(), batch["hn"].to_numpy(), a, b) >= threshold / 100 - MARGIN
                yield batch.loc[near, ["id", "th", "hid", "hth"]]

    joined = pairs.join(reps, ["id", "th"]).join(other, ["hid", "hth"]).select("id", "th", "n", "regs", "hid", "hth", "hn", "hregs")
    return joined.mapInPandas(estimate, "id long, th long, hid long, hth long")


def _texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, th, text) of the wanted documents, once each."""
    needed = materialize(wanted, "needed")
    small = needed.count() <= MAX_BROADCAST_IDS
    found = _texts(docs).withColumnRenamed("doc_id", "id").join(F.broadcast(needed) if small else needed, ["id", "th"])
    return materialize(found.dropDuplicates(["id", "th"]), "texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) of the pairs whose full sets are similar enough."""
    texts = _texts_of(pairs.select("id", "th").unionByName(pairs.select(F.col("hid").alias("id"), F.col("hth").alias("th"))).distinct(), docs)
    other = texts.select(F.col("id").alias("hid"), F.col("th").alias("hth"), F.col("text").alias("htext"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in bounded_slices(batch, rows=256):
                hubs = part.drop_duplicates(["hid", "hth"])
                row_of = {key: i for i, key in enumerate(zip(hubs["hid"], hubs["hth"], strict=True))}
                ours, theirs = (shingles(hash_words(t, lower=True)) for t in (part["text"], hubs["htext"]))
                cut, hub_cut = np.searchsorted(ours[0], np.arange(len(part) + 1)), np.searchsorted(theirs[0], np.arange(len(hubs) + 1))
                keep = np.zeros(len(part), bool)
                for i, key in enumerate(zip(part["hid"], part["hth"], strict=True)):
                    h = row_of[key]
                    a, b = ours[1][cut[i] : cut[i + 1]], theirs[1][hub_cut[h] : hub_cut[h + 1]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep[i] = 100 * both >= threshold * (len(a) + len(b) - both)
                yield pd.DataFrame({"a": part["id"][keep], "b": part["hid"][keep]})

    joined = pairs.join(texts, ["id", "th"]).join(other, ["hid", "hth"]).select("id", "text", "hid", "hth", "htext")
    return joined.mapInPandas(compare, "a long, b long").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows sorted by block: a bucket, or two parts of one that is larger than a block.

    A group ``c`` that fills a block of its bucket has parts of its own, which meet the
    other parts and not each other; smaller groups share parts. So a stray beside a
    group of n rows costs n rows and not their square.
    """
    sizes = materialize(rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n_parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    rest = F.coalesce(F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))), F.lit(0))
    crowded = sizes.groupBy("key").agg(F.sum("n").alias("all"), n_parts(rest).alias("_rest")).filter(F.col("all") > BLOCK).drop("all")
    in_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("_own").over(in_key.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = sizes.filter(F.col("n") > BLOCK).select("key", "c", n_parts(F.col("n")).alias("_own")).withColumn("_before", before).withColumn("_sum", F.sum("_own").over(in_key))
    in_all = materialize(crowded.join(large.groupBy("key").agg(F.max("_sum").alias("_sum")), "key", "left").select("key", "_rest", (F.col("_rest") + F.coalesce("_sum", F.lit(0))).cast("int").alias("_parts")), "crowded")
    own = materialize(large.join(in_all, "key").select("key", "c", "_own", (F.col("_rest") + F.col("_before")).cast("int").alias("_from")), "large")
    discard(sizes)
    placed = rows.join(in_all, "key", "left").join(own, ["key", "c"], "left")
    spread = F.xxhash64("id", "th")
    part = F.when(F.col("_own").isNotNull(), F.col("_from") + F.pmod(spread, F.col("_own"))).otherwise(F.pmod(spread, F.greatest(F.coalesce("_rest", F.lit(1)), F.lit(1))))
    others = F.filter(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1), lambda x: F.col("_own").isNull() | (x < F.col("_from")) | (x >= F.col("_from") + F.col("_own")))
    split = placed.withColumn("part", part.cast("int")).withColumn("_other", F.explode(others))
    blocks = split.withColumns({"lo": F.least("part", "_other"), "hi": F.greatest("part", "_other")}).drop("_own", "_from", "_rest", "_parts", "_other")
    return blocks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _by_block(batches: Iterator[pd.DataFrame], work) -> Iterator[pd.DataFrame]:
    """``work`` on each block of sorted batches; a block is held until the next begins."""
    held: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        key = rows[["key", "lo", "hi"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        out = [found for a, b in zip(starts, starts[1:], strict=False) if b - a > 1 and len(found := work(rows.iloc[a:b]))]
        if out:
            yield pd.concat(out)
        held = rows.iloc[starts[-1] :]
    if held is not None and len(held) > 1 and len(found := work(held)):
        yield found


def _across(block: pd.DataFrame) -> np.ndarray:
    """Which pairs of a block are its own: all of them, or those across its two parts."""
    part = block["part"].to_numpy()
    if block["lo"].iloc[0] == block["hi"].iloc[0]:
        return np.triu(np.ones((len(part), len(part)), bool), 1)
    return np.triu(part[:, None] != part[None, :], 1)


def _hopeful_rows(block: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Rows with a partner of another group that the registers do not rule out, in the
    first band that the two share."""
    regs = np.frombuffer(b"".join(block["regs"]), "<u2").reshape(len(block), -1)
    n, c, band = block["n"].to_numpy(), block["c"].to_numpy(), int(block["band"].iloc[0])
    i, j = np.nonzero(_across(block) & (c[:, None] != c[None, :]) & (100 * np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])))
    active = np.zeros(len(block), bool)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        same = regs[a] == regs[b]
        earlier = same[:, : BAND * band].reshape(len(a), band, BAND).all(2).any(1) if band else np.zeros(len(a), bool)
        use = ~earlier & (same.mean(1) >= threshold / 100 - MARGIN - 0.1)
        a, b = a[use], b[use]
        if len(a):
            near = likely_similarity(n[a], n[b], regs[a], regs[b]) >= threshold / 100 - MARGIN
            active[a[near]] = active[b[near]] = True
    return block.loc[active, ["key", "c", "id", "th"]]


def _in_both(text: np.ndarray, found: np.ndarray, n_texts: int) -> np.ndarray:
    """For each two texts, how many of the shingles are in both."""
    column, times = np.unique(found, return_inverse=True, return_counts=True)[1:]
    # a shingle of one document is in no intersection
    use = times[column] > 1
    text, column = text[use], np.unique(column[use], return_inverse=True)[1]
    both = np.zeros((n_texts, n_texts), np.int64)
    for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        marks = np.zeros((n_texts, COLUMNS), np.float32)
        marks[text[here], column[here] - low] = 1
        both += (marks @ marks.T).astype(np.int64)
    return both


def _linked_rows(block: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """A star of ids for each group of a block whose full sets are similar enough."""
    parts, at = [], 0
    for part in bounded_slices(block[["text"]]):
        owner, found = shingles(hash_words(part["text"], lower=True))
        parts.append(((owner + at).astype(np.int32), found))
        at += len(part)
    text, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.bincount(text, minlength=len(block))
    both = np.zeros((len(block), len(block)), np.int64)
    # the shingles of long texts are counted in ranges of their hashes
    ranges = -(-len(found) // ROOM)
    for r in range(ranges):
        here = (found >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32) == r
        both += _in_both(text[here], found[here], len(block))
    near = _across(block) & (100 * both >= threshold * (n[:, None] + n[None, :] - both))
    near |= near.T
    ids, waiting, stars = block["id"].to_numpy(), near.any(1), []
    for i in np.flatnonzero(waiting):
        if waiting[i]:
            members = frontier = np.asarray([i])
            waiting[i] = False
            while len(frontier):
                frontier = np.flatnonzero(near[frontier].any(0) & waiting)
                waiting[frontier] = False
                members = np.concatenate([members, frontier])
            root = ids[members].min()
            stars += [(m, root) for m in ids[members] if m != root]
    return pd.DataFrame(stars, columns=["a", "b"], dtype="int64")


def _compared(rows: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Edges within buckets that hold several groups: registers pick rows, full sets link them."""
    hopeful = _dealt(rows).mapInPandas(lambda it: _by_block(it, lambda b: _hopeful_rows(b, threshold)), "key long, c long, id long, th long")
    active = materialize(hopeful.distinct(), "active")
    texts = _texts_of(active.select("id", "th").distinct(), docs)
    blocks = _dealt(active.join(texts, ["id", "th"]))
    return blocks.mapInPandas(lambda it: _by_block(it, lambda b: _linked_rows(b, threshold)), "a long, b long").distinct()


def _links(sketched: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) that connect every two documents that are linked, directly or not."""
    usable = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(usable.groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc_id").alias("id"), "th", "n", "regs")).alias("r")).select("f1", "f2", "r.*"), "reps")
    copies = usable.join(reps.select("f1", "f2", F.col("id").alias("rep")), ["f1", "f2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    sketches = reps.select("id", "th", "n", "regs")
    keys = [F.expr(f"xxhash64({i}, substring(regs, {2 * BAND * i + 1}, {2 * BAND}))") for i in range(REGISTERS // BAND)]
    bands = reps.select("id", "th", F.posexplode(F.array(*keys)).alias("band", "key"))
    hubs = materialize(bands.groupBy("key").agg(F.min(F.struct("id", "th")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.col("hub.id").alias("hid"), F.col("hub.th").alias("hth")), "hubs")
    crowd = materialize(bands.join(hubs, "key"), "crowd")
    first = materialize(crowd.filter("id <> hid").groupBy("id", "th").agg(F.min(F.struct("hid", "hth")).alias("h")).select("id", "th", "h.hid", "h.hth"), "first")
    tried = materialize(_hopeful(first, sketches, threshold), "hopeful")
    edges = materialize_alone(lambda: _confirmed(tried, docs, threshold), "edges")
    grouped = materialize_alone(lambda: connected_components(edges), "groups")
    placed = crowd.join(grouped.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", "th", F.coalesce("component", "id").alias("c"))
    mixed = materialize(placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"), "mixed")
    left = materialize(placed.join(mixed, "key").join(sketches, ["id", "th"]), "left")
    return edges.unionByName(materialize_alone(lambda: _compared(left, docs, threshold), "edges")).unionByName(copies)


def group_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Set size and group of each document.

    Takes ``doc_id`` and ``text``; other columns are ignored. Two documents are linked
    if the intersection of their sets of five-word shingles (A-Z lower-cased, words
    between white space) is at least ``threshold`` hundredths of the union. Returns
    doc_id, n_shingles, component_id (smallest linked id, directly or not) and kept
    (whether that is the document's own). A text without words, or null, has an empty
    set and links with nothing. A null doc_id links with nothing and has null component
    and kept. Rows that repeat an id are one document with the links of all of them,
    and a row each. An empty table gives an empty one.

    Equal word sequences are grouped first and only the smallest id of each goes on. In
    a band, each document is first held against the smallest of its bucket; after that
    only buckets that hold several groups are left, and these are compared in blocks
    whose tasks return a tree of links for each group, so no pairs are written out.
    Nothing is dropped for size.
    """
    bounded_batches(docs.sparkSession)
    sketched = materialize(sketch_documents(docs), "sketches")
    joined = materialize_alone(lambda: connected_components(_links(sketched, docs, threshold)), "components")
    return sketched.join(joined, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that a smaller id of their group stands for; all columns stay."""
    name = free_name("_gone", docs)
    gone = materialize_alone(lambda: group_near_duplicates(docs, threshold).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    small = gone.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate group of every document."""
    return group_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_minhash_neardup": op2_minhash_neardup}
ORACLE_SQL = {
    "op2_minhash_neardup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""
}
