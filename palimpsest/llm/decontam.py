"""Benchmark decontamination by spaced seeds that no allowed overlap can avoid.

A seed hashes the tokens that a mask selects and ignores those between. The masks are
chosen so that a stretch of which 80 % are equal has a hit of one of them wherever its
changes fall; so no overlap goes unseen. Seeds of documents
that pass a bitmap of benchmark seeds are joined with the benchmark's; each diagonal that
a hit names is then verified over its full length, token by token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, bounded_slices, materialize, materialize_alone
from palimpsest.llm.wordhash import as_bytes, hash_words, mix

#: Masks of the seeds. Least changes that leave neither a hit, by the number of tokens:
#: 13 to 14: 3, 15 to 19: 4, 20 to 24: 5, ...; always more than a fifth (a test counts them).
MASKS = ("111011", "1101101")
#: Items from this many tokens may differ in places; shorter ones must be equal throughout.
SPAN = 13
#: Tokens that a verified overlap spans at least, or the whole item where it is shorter,
#: and the share of them that must be equal.
MIN_SPAN, MIN_EQUAL = 20, 0.8
#: Items below this many tokens are too short to tell from common phrases.
MIN_ITEM = 5
#: Bits of the broadcast bitmap, 16 MiB whatever the size of the benchmark.
FILTER_BITS = 27

_BASE = np.uint64(0xA0761D6478BD642F)
_PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
SCAN_SCHEMA = "doc_id long, fingerprint long, text string, found array<struct<seed:long,at:int>>"
ITEM_SCHEMA = "item_id long, item_fp long, item string, n int, seeds array<struct<seed:long,item_at:int>>"
HIT_SCHEMA = "doc_id long, fingerprint long, item_id long, doc_start int, doc_end int, item_start int, equal int"


def tokens(text) -> bytes:
    """Lower-case (A-Z) text with ASCII punctuation blanked."""
    return as_bytes(text, lower=True).translate(_PLAIN)


def _hash(texts) -> tuple[np.ndarray, np.ndarray]:
    words = hash_words(t.decode("utf-8", "surrogatepass") for t in texts)
    return words.hashes, words.first


def seeds(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Seed of each place; len(mask) - 1 fewer than tokens."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt + 1), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out *= _BASE
            out += hashes[j : j + n]
    return mix(out)


def masks_for(length: int) -> tuple[str, ...]:
    """Masks of which every overlap with an item of this many tokens must hit one; none below MIN_ITEM."""
    if length < MIN_ITEM:
        return ()
    return MASKS if length >= SPAN else ("1" * length,)


def _benchmark(benchmark: DataFrame) -> DataFrame:
    """Every item with its tokens, their number and its seeds."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = [tokens(t) for t in batch["text"]]
            hashes, first = _hash(plain)
            for i, (item, fp) in enumerate(zip(batch["item_id"], batch["item_fp"], strict=True)):
                own = hashes[first[i] : first[i + 1]]
                if masks := masks_for(len(own)):
                    found = [{"seed": s, "item_at": k} for mask in masks for k, s in enumerate(seeds(own, mask, int(mask, 2)).view(np.int64).tolist())]
                    yield pd.DataFrame({"item_id": pd.array([None if pd.isna(item) else int(item)], "Int64"), "item_fp": [fp], "item": [plain[i].decode("utf-8", "surrogatepass")], "n": [len(own)], "seeds": [found]})

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    return materialize(items.withColumn("item_fp", F.xxhash64("text")).mapInPandas(rows, ITEM_SCHEMA), "benchmark")


def _bitmap(table: DataFrame, bits: int) -> bytes:
    """A compressed bitmap of the seeds' low bits; its size is fixed by ``bits``."""
    part_bits = 20

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots in batch.groupby("part")["slot"]:
                held.setdefault(part, np.zeros(1 << part_bits, bool))[slots.to_numpy()] = True
        for part, flags in held.items():
            yield pd.DataFrame({"part": [part], "flags": [zlib.compress(np.packbits(flags).tobytes(), 1)]})

    slot = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    slots = table.select(F.shiftright(slot, part_bits).cast("int").alias("part"), slot.bitwiseAND(F.lit((1 << part_bits) - 1)).cast("int").alias("slot")).distinct()
    size = 1 << (part_bits - 3)
    out = bytearray(1 << (bits - 3))
    for row in slots.repartition("part").mapInPandas(mark, "part int, flags binary").collect():
        out[row.part * size : (row.part + 1) * size] = zlib.decompress(row.flags)
    return zlib.compress(bytes(out), 1)


def overlaps(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The best verified overlap of each document and benchmark item.

    Takes ``doc_id``/``text`` and ``item_id``/``text``; other columns are ignored.
    Returns doc_id, fingerprint (xxhash64 of the text, to tell repeated ids apart),
    item_id, doc_start and doc_end (tokens), item_start and equal (equal tokens). An
    overlap is a diagonal stretch of at least 20 tokens, or the whole of a shorter
    item, of which 80 % are equal; the longest of a diagonal counts. Items of fewer than 13
    tokens must be equal throughout and those of fewer than 5 match nothing. Null and empty texts match
    nothing; a null id is returned as null. Equal rows give one row. Either table may
    be empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = _benchmark(benchmark)
    table = items.select("item_id", "item_fp", F.inline("seeds"))
    shared = spark.sparkContext.broadcast(_bitmap(table, bits))
    # at most as many as there are lengths of items below SPAN
    masks = sorted({mask for r in items.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect() for mask in masks_for(r.n)})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        low = np.uint64((1 << bits) - 1)
        for batch in batches:
            for part in bounded_slices(batch, rows=1024):
                plain = [tokens(t) for t in part["text"]]
                hashes, first = _hash(plain)
                found_in: dict[int, list[dict]] = {}
                for mask in masks:
                    found = seeds(hashes, mask, int(mask, 2))
                    slot = (found & low).astype(np.int64)
                    at = np.flatnonzero(flags[slot >> 3] & (np.uint8(128) >> (slot & 7).astype(np.uint8)))
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + len(mask) <= first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    for d, seed, here in zip(doc.tolist(), found[at].view(np.int64).tolist(), (at - first[doc]).tolist(), strict=True):
                        found_in.setdefault(d, []).append({"seed": seed, "at": here})
                if found_in:
                    frame = part.iloc[list(found_in)][["doc_id", "fingerprint", "text"]].assign(found=list(found_in.values()))
                    frame["doc_id"] = frame["doc_id"].astype("Int64")
                    yield frame

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                doc, item = tokens(r.text).split(), r.item.encode("utf-8", "surrogatepass").split()
                rows.extend((r.doc_id, r.fingerprint, r.item_id, *best) for shift in r.shifts if (best := verified(doc, item, int(shift))))
            if rows:
                frame = pd.DataFrame(rows, columns=["doc_id", "fingerprint", "item_id", "doc_start", "doc_end", "item_start", "equal"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").withColumn("fingerprint", F.xxhash64("text"))
    near = materialize(rows.mapInPandas(scan, SCAN_SCHEMA), "seeded").dropDuplicates(["doc_id", "fingerprint"])
    diagonals = near.select("doc_id", "fingerprint", F.inline("found")).join(table, "seed")
    diagonals = diagonals.groupBy("doc_id", "fingerprint", "item_id", "item_fp").agg(F.collect_set(F.col("item_at") - F.col("at")).alias("shifts")).alias("g")
    texts, whole = near.select("doc_id", "fingerprint", "text").alias("t"), items.select("item_id", "item_fp", "item").alias("i")
    pairs = diagonals.join(texts, F.expr("g.fingerprint = t.fingerprint AND g.doc_id <=> t.doc_id")).join(whole, F.expr("g.item_fp = i.item_fp AND g.item_id <=> i.item_id"))
    hits = pairs.select("g.doc_id", "g.fingerprint", "g.item_id", "g.shifts", "t.text", "i.item").mapInPandas(verify, HIT_SCHEMA)
    best = F.max(F.struct("equal", (-F.col("doc_start")).alias("first"), "doc_end", "item_start")).alias("best")
    return hits.groupBy("doc_id", "fingerprint", "item_id").agg(best).select("doc_id", "fingerprint", "item_id", (-F.col("best.first")).alias("doc_start"), "best.doc_end", "best.item_start", "best.equal")


def verified(doc: list, item: list, shift: int) -> tuple[int, int, int, int] | None:
    """(doc_start, doc_end, item_start, equal) of the longest overlap on a diagonal.

    Place ``i`` of the document meets place ``i + shift`` of the item.
    """
    low, high = max(0, -shift), min(len(doc), len(item) - shift)
    need = min(MIN_SPAN, len(item))
    if high - low < need:
        return None
    same = np.fromiter((doc[i] == item[i + shift] for i in range(low, high)), bool, high - low)
    total = np.concatenate([[0], np.cumsum(same)])
    share = round((MIN_EQUAL if len(item) >= SPAN else 1.0) * 100)
    # a stretch has the share where this sum does not fall from its start to its end
    over = 100 * total - share * np.arange(len(total))
    start = np.searchsorted(-np.minimum.accumulate(over), -over, "left")
    sizes = np.arange(len(total)) - start
    size = int(sizes.max())
    if size < need:
        return None
    ends = np.flatnonzero(sizes == size)
    end = int(ends[np.argmax(total[ends] - total[ends - size])])
    begin = low + end - size
    return begin, begin + size, begin + shift, int(total[end] - total[end - size])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item; all columns stay."""
    found = materialize_alone(lambda: overlaps(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_fp")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_fp"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item: one row for each document and item."""
    found = overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "doc_start", "doc_end", "item_start", "equal")


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL: dict[str, str] = {}
