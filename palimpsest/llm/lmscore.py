"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, one of target documents and one of all documents, match
in all but what they count: one vocabulary, one order, one smoothing. A document's score
is the mean difference of their losses by token: the lower, the more it reads like the
target. What a document itself adds to a model is taken out before it is scored, or
every document of the target, and every rare phrase, would vouch for itself.

Every word and every bigram is counted for itself, over all documents, in buckets that
grow in number with the corpus and that no task holds whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chunks import answered, asked, bucket_count, characters, chunked, met, pack, unpack
from palimpsest.llm.common import discard, materialize
from palimpsest.llm.wordhash import Words, gram_hashes, hash_words

#: Bytes of text of a chunk; a larger one asks less often for a common n-gram.
CHUNK_CHARS = 8_000_000
#: Bits by which the hash of an n-gram is longer than the number of words: any n-gram
#: shares its hash with another one with a chance below 2 ** -23, whatever the corpus's size.
SPARE_BITS = 24
#: Words that occur less often than this share one entry of the vocabulary.
MIN_COUNT = 2
#: Share of the bigram estimate; the rest is the smoothed unigram.
BIGRAM_SHARE = 0.7
#: Ids that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
WORD, BIGRAM = 0, 1

SCORE_SCHEMA = "doc_id long, no_id boolean, n_tokens long, target_loss double, background_loss double, difference double"


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that follow another in their text, and the bigrams that end there."""
    follows = np.ones(len(words.hashes), bool)
    follows[words.first[:-1][words.counts() > 0]] = False
    at = np.flatnonzero(follows)
    return at, gram_hashes(words.hashes, 2)[at - 1] if len(at) else np.zeros(0, np.uint64)


def _add_up(kind: int, which: np.ndarray, ends: list[int], said: list[bytes]) -> Iterator[tuple[bytes, list[int] | None]]:
    """Counts over all chunks, by model, of the n-grams that each chunk asked for.

    With the first answer of a bucket of words comes what it adds to the vocabulary: known
    words, tokens of unknown ones and all tokens, the last two by model.
    """
    counts = np.concatenate([unpack(raw, np.int64).reshape(2, -1) for raw in said], axis=1)
    # sums of doubles are exact below 2 ** 53 tokens
    total = np.stack([np.bincount(which, weights=c) for c in counts]).astype(np.int64)
    rare = total[1] < MIN_COUNT
    stats = [int((~rare).sum()), *total[:, rare].sum(1).tolist(), *total.sum(1).tolist()]
    for n, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        yield pack(total[:, which[start:end]]), stats if kind == WORD and n == 0 else None


def _own(doc: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How often the n-gram at each place occurs in the document of that place."""
    if not len(which):
        return np.zeros(0)
    same, n = np.unique(doc * (int(which.max()) + 1) + which, return_inverse=True, return_counts=True)[1:]
    return n[same].astype(float)


def _losses(words: Words, width: int, hit: np.ndarray, unigrams: np.ndarray, bigrams: np.ndarray, stats: list[int]) -> np.ndarray:
    """Model, token: loss in nats. Counts are those of the sorted distinct n-grams of the words."""
    known_words, *sums = stats
    rare, totals = sums[:2], sums[2:]
    at, pairs = _bigrams(words)
    shift = np.uint64(64 - width)
    which, pair = (np.unique(grams >> shift, return_inverse=True)[1] for grams in (words.hashes, pairs))
    doc, n = words.text_of_word(), words.counts().astype(float)
    known = (unigrams[1] >= MIN_COUNT)[which]
    own, own_pair = _own(doc, which), _own(doc[at], pair)
    own_entry = np.where(known, own, np.bincount(doc, weights=~known, minlength=len(n))[doc])
    out = np.empty((2, len(which)))
    for k in range(2):
        mine = np.ones(len(which)) if k else hit[doc].astype(float)
        entry = np.where(known, unigrams[k][which], rare[k]) - mine * own_entry
        unigram = (entry + 1.0) / (totals[k] - mine * n[doc] + known_words + 1)
        context, seen = np.zeros(len(which)), np.zeros(len(which))
        context[at] = unigrams[k][which[at - 1]] - mine[at] * own[at - 1]
        seen[at] = bigrams[k][pair] - mine[at] * own_pair
        # an unseen context leaves everything to the unigram
        share = np.where(context > 0, BIGRAM_SHARE, 0.0)
        out[k] = -np.log(share * (seen / np.maximum(context, 1.0)) + (1 - share) * unigram)
    return out


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of every document.

    ``target`` names the target documents by ``doc_id``; the background is all of
    ``docs``. Either model leaves out the scored row's own words. Losses are means by
    token, in nats. Words are runs of characters between white space. A text without
    words, or null, has no tokens and losses and difference 0. Without target documents
    the target model is uniform over the vocabulary. Repeated rows count and are scored
    each; ids of ``target`` that no document has, and null ids, count for nothing.
    Other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    chars = characters(rows)
    buckets, width = bucket_count(chars), min(64, max(32, math.ceil(math.log2(chars / 2 + 1)) + SPARE_BITS))
    ids = materialize(target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("hit", F.lit(1)), "target")
    small = ids.count() <= MAX_BROADCAST_IDS
    flagged = rows.join(F.broadcast(ids) if small else ids, "doc_id", "left")
    chunks = chunked(flagged.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("hit").isNotNull().alias("hit"), "text"), CHUNK_CHARS)
    discard(ids)

    def ask(part: pa.Table) -> Iterator[tuple]:
        words = hash_words(part.column("text").to_pylist())
        hit = np.repeat(part.column("hit").to_numpy(), words.counts())
        at, pairs = _bigrams(words)
        for kind, grams, hits in ((WORD, words.hashes, hit), (BIGRAM, pairs, hit[at])):
            keys, which = np.unique(grams >> np.uint64(64 - width), return_inverse=True)
            counts = np.stack([np.bincount(which[hits], minlength=len(keys)), np.bincount(which, minlength=len(keys))])
            yield kind, keys, lambda i, j, counts=counts: pack(counts[:, i:j])

    answers = answered(asked(chunks, ask, width, buckets), _add_up)
    stats = [n or 0 for n in answers.filter("stats IS NOT NULL").agg(*(F.sum(F.col("stats")[i]) for i in range(5))).first()]

    def score(part: pa.Table, told: dict[int, list[bytes]]) -> pd.DataFrame:
        words = hash_words(part.column("text").to_pylist())
        n = words.counts()
        counts = [np.concatenate([np.zeros((2, 0), np.int64), *(unpack(raw, np.int64).reshape(2, -1) for raw in told.get(kind, []))], axis=1) for kind in (WORD, BIGRAM)]
        losses = _losses(words, width, part.column("hit").to_numpy(), *counts, stats)
        total = np.concatenate([np.zeros((2, 1)), np.cumsum(losses, axis=1)], axis=1)
        means = (total[:, words.first[1:]] - total[:, words.first[:-1]]) / np.maximum(n, 1)
        return pd.DataFrame({"doc_id": part.column("doc_id").to_numpy(), "no_id": part.column("no_id").to_numpy(), "n_tokens": n, "target_loss": means[0], "background_loss": means[1], "difference": means[0] - means[1]})

    scored = met(chunks, answers, score, SCORE_SCHEMA)
    return scored.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_tokens", "target_loss", "background_loss", "difference")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the documents labelled as of good quality."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    return cross_entropy_difference(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLE_SQL: dict[str, str] = {}
