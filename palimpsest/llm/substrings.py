"""Substring deduplication with repeated-phrase automata.

A window is 13 consecutive words. Among the nine-word grams of a window the smallest hash
is its anchor, the same wherever the window occurs, and neighbouring windows mostly share
one. Chunks of documents ask buckets which anchors occur in two documents or more; an
anchor of one document rules its windows out. Runs of the windows left are passages, dealt
by anchors of three-word grams into shards; a shard confirms which windows recur across
documents, compiles them into an Aho-Corasick automaton over words, and streams its
passages through it to find every occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chunks import answered, asked, bucket_count, characters, chunked, key_counts, met
from palimpsest.llm.common import bounded_batches, discard, free_name, materialize, release
from palimpsest.llm.wordhash import Words, as_bytes, gram_hashes, hash_words, mix, sliding

WINDOW, GRAM, ROUTE_GRAM = 13, 9, 3
#: Windows of a passage at most; a longer run with one anchor is several passages.
MAX_PASSAGE = 64
#: Bits by which the hash of an anchor is longer than the number of words: of the anchors
#: of one document, one in 2 ** 8 is taken for a recurring one, whatever the corpus's size.
#: Its windows are dealt for nothing; the result does not change.
SPARE_BITS = 8
#: Passages that one automaton is compiled from, about; more of one anchor than
#: HEAVY are dealt window by window instead, each window once.
SHARD_PASSAGES, HEAVY = 8_192, 2_048
#: Heavy anchors that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_HEAVY = 100_000
NO_ID = (1 << 63) - 1

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def anchors(words: Words, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place, anchor) of each window; places count through the batch."""
    text = words.text_of_word()
    if len(text) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(gram_hashes(words.hashes, gram), WINDOW - gram + 1)
    inside = np.flatnonzero(text[: len(least)] == text[WINDOW - 1 :])
    return inside, least[inside]


def _keys(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key) of each window, the key by its place among the sorted distinct keys; and those."""
    place, anchor = anchors(words)
    # a minimum is a small number; mixed, its leading bits are even
    keys, which = np.unique(mix(anchor) >> np.uint64(64 - width), return_inverse=True)
    return place, which, keys


def _shared(words: Words, order: np.ndarray, place: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Whether each key occurs in two documents of the chunk; equal ids are one document."""
    name = pd.factorize(order)[0][np.searchsorted(words.first, place, "right") - 1]
    lo, hi = np.full(n, len(order)), np.full(n, -1)
    np.minimum.at(lo, which, name)
    np.maximum.at(hi, which, name)
    return lo < hi


def _recurs(_kind: int, which: np.ndarray, ends: list[int], said: list[bytes]) -> Iterator[tuple[bytes, None]]:
    """A bit for each asked key: whether several chunks ask, or one that holds it in two documents."""
    starts = [0, *ends[:-1]]
    shared = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=b - a) for a, b, s in zip(starts, ends, said, strict=True)])
    recurring = np.bincount(which, weights=1 + shared) > 1
    for a, b in zip(starts, ends, strict=True):
        yield np.packbits(recurring[which[a:b]]).tobytes(), None


PASSAGE_SCHEMA = "kind int, route long, key long, o long, fp long, hi long, start int, text binary"


def passages(chunks: DataFrame, width: int, buckets: int) -> DataFrame:
    """Runs of windows that may recur and share an anchor (kind 0, once a chunk, with
    smallest and largest document) and their occurrences (kind 1)."""

    def ask(docs: pa.Table) -> Iterator[tuple]:
        words = hash_words(docs.column("text").to_pylist())
        place, which, keys = _keys(words, width)
        shared = _shared(words, docs.column("o").to_numpy(), place, which, len(keys))
        yield 0, keys, lambda i, j: np.packbits(shared[i:j]).tobytes()

    def scan(docs: pa.Table, answers: dict[int, list[bytes]]) -> pd.DataFrame | None:
        texts = docs.column("text").to_pylist()
        words = hash_words(texts)
        place, which, keys = _keys(words, width)
        if not len(place):
            return None
        cut = key_counts(keys, width, buckets)
        recurring = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=n) for a, n in zip(answers[0], cut, strict=True)]).astype(bool)
        place = place[recurring[which]]
        if not len(place):
            return None
        window = gram_hashes(words.hashes, WINDOW)[place]
        anchor = sliding(gram_hashes(words.hashes, ROUTE_GRAM), WINDOW - ROUTE_GRAM + 1)[place]
        doc = np.searchsorted(words.first, place, "right") - 1
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        run = np.flatnonzero(fresh)
        begin = run[np.cumsum(fresh) - 1]
        fresh |= (np.arange(len(place)) - begin) % MAX_PASSAGE == 0
        run = np.flatnonzero(fresh)
        n = np.diff(np.append(run, len(place)))
        key = _passage_keys(window, run, n)
        order, fingerprint = docs.column("o").to_numpy(), docs.column("fp").to_numpy()
        d = doc[run]
        start = place[run] - words.first[d]
        found = pd.DataFrame({"kind": 1, "route": np.int64(0), "key": key, "o": order[d], "fp": fingerprint[d], "hi": np.int64(0), "start": start, "text": None})
        distinct, first, of = np.unique(key, return_index=True, return_inverse=True)
        lo, hi = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID)
        np.minimum.at(lo, of, order[d])
        np.maximum.at(hi, of, order[d])
        own, split, at = [b""] * len(distinct), None, -1
        for i in np.argsort(d[first], kind="stable"):
            j = first[i]
            if d[j] != at:
                at, split = d[j], as_bytes(texts[d[j]]).split()
            own[i] = b" ".join(split[start[j] : start[j] + n[j] + WINDOW - 1])
        once = pd.DataFrame({"kind": 0, "route": anchor[run][first].view(np.int64), "key": distinct, "o": lo, "fp": np.int64(0), "hi": hi, "start": 0, "text": own})
        return pd.concat([found, once])

    answers = answered(asked(chunks, ask, width, buckets), _recurs)
    found = materialize(met(chunks, answers, scan, PASSAGE_SCHEMA), "passages")
    discard(answers)
    return found


def _passage_keys(windows: np.ndarray, run: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the windows of each run, wherever the run lies."""
    powers = np.full(len(windows) + 1, np.uint64(_BASE))
    powers[0] = 1
    inverse = np.full(len(windows) + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
    inverse[0] = 1
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    total = np.concatenate([[np.uint64(0)], np.cumsum(windows * powers[:-1], dtype=np.uint64)])
    return mix((total[run + n] - total[run]) * inverse[run] + n.astype(np.uint64) * _STEP).view(np.int64)


VERDICT_SCHEMA = "key long, shift int, smallest binary"


def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream sorted passages; compile and run one automaton for each shard of routes."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size >= SHARD_PASSAGES:
            rows = pd.concat(held, ignore_index=True)
            route = rows["route"].to_numpy()
            cut = int(np.searchsorted(route, route[-1]))  # the last route may go on
            if cut:
                yield from _shard(rows.iloc[:cut])
            held, size = [rows.iloc[cut:]], len(rows) - cut
    if size:
        yield from _shard(pd.concat(held, ignore_index=True))


def _shard(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    # one row of each passage, with the smallest and the largest document of all its slices
    name = rows["key"].to_numpy().view(np.uint64) + rows["shift"].to_numpy().astype(np.uint64) * _STEP
    once, row, of = np.unique(name, return_index=True, return_inverse=True)
    smallest, largest = np.full(len(once), NO_ID), np.full(len(once), -NO_ID)
    np.minimum.at(smallest, of, rows["o"].to_numpy())
    np.maximum.at(largest, of, rows["hi"].to_numpy())
    rows = rows.iloc[row].assign(o=smallest, hi=largest)
    words = hash_words(rows["text"])
    first, n = words.first, words.counts() - WINDOW + 1
    # words become characters, so that the automaton steps from word to word
    code = np.unique(words.hashes, return_inverse=True)[1] + 1
    whole = np.where(code >= 0xD800, code + 0x800, code).astype("<u4").tobytes().decode("utf-32-le")
    place = np.concatenate([np.arange(a, a + k) for a, k in zip(first[:-1], n, strict=True)])
    owner = np.repeat(np.arange(len(rows)), n)
    window = gram_hashes(words.hashes, WINDOW)[place]
    order = np.argsort(window, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], window[order][1:] != window[order][:-1]]))
    lo = np.minimum.reduceat(rows["o"].to_numpy()[owner][order], begin)
    hi = np.maximum.reduceat(rows["hi"].to_numpy()[owner][order], begin)
    confirmed = np.flatnonzero(lo < hi)
    if not len(confirmed):
        return
    automaton = ahocorasick.Automaton()
    for p, smallest in zip(place[order[begin[confirmed]]].tolist(), lo[confirmed].tolist(), strict=True):
        automaton.add_word(whole[p : p + WINDOW], smallest)
    automaton.make_automaton()
    out = []
    for i, key, shift in zip(range(len(rows)), rows["key"], rows["shift"], strict=True):
        found = None
        for end, smallest in automaton.iter(whole[first[i] : first[i + 1]]):
            if found is None:
                found = np.full(n[i], NO_ID, "<i8")
            found[end - WINDOW + 1] = smallest
        if found is not None:
            out.append((key, shift, found.tobytes()))
    for at in range(0, len(out), 20_000):
        yield pd.DataFrame(out[at : at + 20_000], columns=["key", "shift", "smallest"])


def _by_window(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages of heavy anchors as one row for each window, routed by the window's own hash."""
    for batch in batches:
        for from_ in range(0, len(batch), 512):
            rows = []
            for key, o, hi, text in batch.iloc[from_ : from_ + 512][["key", "o", "hi", "text"]].itertuples(index=False):
                split = text.split()
                windows = gram_hashes(hash_words([text]).hashes, WINDOW).view(np.int64)
                rows += [(w, key, k, o, hi, b" ".join(split[k : k + WINDOW])) for k, w in enumerate(windows)]
            if rows:
                yield pd.DataFrame(rows, columns=["route", "key", "shift", "o", "hi", "text"])


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for o, fp, start, shift, smallest in batch[["o", "fp", "start", "shift", "smallest"]].itertuples(index=False):
            at = np.flatnonzero(np.frombuffer(smallest, "<i8") < o)
            if len(at):
                out.append((o, fp, (at + (start + shift)).astype("<i4").tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["o", "fp", "starts"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(o, fp, starts): for each document, by id and text hash, the first words of its
    windows that a document with a smaller id holds too."""
    spark = docs.sparkSession
    rows = _rows(docs).select("o", "fp", F.col("text").cast("binary").alias("text"))
    chars = characters(rows)
    width = min(64, max(32, math.ceil(math.log2(chars / 6 + 1)) + SPARE_BITS))
    chunks = chunked(rows)
    found = passages(chunks, width, bucket_count(chars))
    discard(chunks)
    release(spark)
    distinct = found.filter("kind = 0")
    heavy = materialize(distinct.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HEAVY).select("route"), "heavy")
    n_heavy = heavy.count()
    dealt = distinct.select("route", "key", F.lit(0).alias("shift"), "o", "hi", "text")
    if n_heavy:
        marked = F.broadcast(heavy) if n_heavy <= MAX_BROADCAST_HEAVY else heavy
        windows = materialize(distinct.join(marked, "route", "left_semi").mapInPandas(_by_window, "route long, key long, shift int, o long, hi long, text binary"), "windows")
        # a window of many passages is one row, added up before it is dealt
        once = windows.groupBy("route").agg(F.min("o").alias("o"), F.max("hi").alias("hi"), F.first("text").alias("text"))
        dealt = dealt.join(marked, "route", "left_anti").unionByName(once.select("route", F.col("route").alias("key"), F.lit(-1).alias("shift"), "o", "hi", "text"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // 64_000_000)
    verdicts = materialize(dealt.repartition(n_parts, "route").sortWithinPartitions("route").mapInPandas(confirm, VERDICT_SCHEMA), "verdicts")
    release(spark)
    told = verdicts
    if n_heavy:
        of_window = verdicts.filter("shift = -1").select(F.col("key").alias("route"), "smallest")
        told = verdicts.filter("shift >= 0").unionByName(windows.select("route", "key", "shift").distinct().join(of_window, "route").select("key", "shift", "smallest"))
    places = found.filter("kind = 1").select("key", "o", "fp", "start")
    covers = materialize(places.join(told, "key").select("o", "fp", "start", "shift", "smallest").mapInPandas(_cover, "o long, fp long, starts binary"), "covers")
    for done in (found, verdicts, heavy, *([windows] if n_heavy else [])):
        discard(done)
    release(spark)
    # a set: rows that repeat a document add nothing
    return covers.groupBy("o", "fp").agg(F.collect_set("starts").alias("starts"))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "o": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "fp": F.xxhash64(text)})


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut from the texts, and ``_n_words`` and ``_n_removed``.

    Takes ``doc_id`` and ``text``; other columns stay, whatever their names: where one has
    the name of an added column, that gets underscores before it. Words are runs of characters
    between white space, unchanged. Each word that a window covers whose words also
    start in a document with a smaller doc_id goes; windows are judged on the input.
    Kept words are joined by one space where something was removed, and the text stays
    as it was where nothing was. A null text has no words and stays null. A null id
    counts as larger than any other; rows with equal ids are one document, which never
    repeats itself, and each keeps its row. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    o, fp, places_of, key_o, key_fp, done, n_words, n_removed = (free_name(n, docs) for n in ("_o", "_fp", "_starts", "_key_o", "_key_fp", "_cut", "_n_words", "_n_removed"))
    starts = repeated_windows(docs.select("doc_id", "text")).select(F.col("o").alias(o), F.col("fp").alias(fp), F.col("starts").alias(places_of))
    keyed = docs.withColumns({key_o: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key_fp: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            out = []
            for text, places in zip(texts, lists, strict=True):
                words = as_bytes(text).split()
                if places is None or not len(places):
                    out.append((text, len(words), 0))
                    continue
                at = np.concatenate([np.frombuffer(p, "<i4") for p in places])
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                out.append((b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode("utf-8", "surrogatepass"), len(words), int(gone.sum())))
            yield pd.DataFrame(out, columns=["text", "n_words", "n_removed"])

    joined = keyed.join(starts, (F.col(key_o) == F.col(o)) & (F.col(key_fp) == F.col(fp)), "left")
    cutting = joined.withColumn(done, cut(F.col("text").cast("string"), F.col(places_of)))
    return cutting.withColumns({"text": F.col(f"{done}.text"), n_words: F.col(f"{done}.n_words"), n_removed: F.col(f"{done}.n_removed")}).drop(done, places_of, o, fp, key_o, key_fp)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and a digest of the kept words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = remove_repeated(docs)
    # a text without repeats is digested in the same form: words joined by one space
    plain = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return done.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.when(F.col("_n_removed") > 0, F.col("text")).otherwise(plain).cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL = {
    "op7_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w WHERE len(l) >= 13)
), m AS (SELECT g, min(doc_id) AS first_id FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (g) WHERE first_id < doc_id),
k AS (
  SELECT t.doc_id, count(*) AS n_words, count(c.j) AS n_removed,
         coalesce(string_agg(t.word, ' ' ORDER BY t.j) FILTER (c.j IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS j FROM w) t LEFT JOIN c ON t.doc_id = c.doc_id AND t.j = c.j
  GROUP BY t.doc_id
)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
}
