"""Alignment of two tokenizers' tokens by the bytes that they cover.

The texts of an Arrow batch are laid end to end, each with its byte offset, so that one
count of the ends of either tokenizer's tokens serves the whole batch: both texts may be
cut where tokens of both end. Differences of prefix sums at the documents' ends give each
document its own figures.

Both tokenizers leave a boundary between a character that is not white space and a space
after it, and neither looks past one. Words between single spaces are therefore encoded
once and remembered; a text with other runs of white space is encoded whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.chunks import opened, pack, unpack
from palimpsest.llm.common import bounded_batches, bounded_slices, materialize

#: Words that a worker remembers, and the longest of them in characters.
MAX_UNITS, MAX_UNIT_CHARS = 100_000, 48
#: Characters of a slice of a batch, links listed at once, and pair entries of a chunk.
SLICE_CHARS, LIST_LINKS, CHUNK_PAIRS = 1_500_000, 2_000_000, 4_000_000
#: Bytes of text whose token ends are counted at once.
WINDOW = 1 << 22
#: A pair's key: the first tokenizer's id above these bits, the second's below.
ID_BITS = 20

RESULT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@cache
def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others are, in order, the characters from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and what was encoded before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        # a special token's name may be spelled with characters of no byte; it never occurs here
        self.bytes_a = [bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode() for name in names]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.sizes_a, self.sizes_b = (np.asarray([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple] = {}

    def whole(self, texts: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of each text by either tokenizer, and whether both give back its bytes."""
        ours = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        theirs = self.b.encode(texts, num_threads=1)
        out = []
        for text, a, b in zip(texts, ours, theirs, strict=True):
            raw = (" " + text).encode()
            same = b"".join(map(self.bytes_a.__getitem__, a.ids)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            out.append((a.ids, b, same))
        return out

    def units(self, words: list[str]) -> list[tuple]:
        """``whole`` for words, most of them remembered."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MAX_UNITS:
            self.known, new = {}, words
        fresh = dict(zip(new, self.whole(new), strict=True))
        found = [fresh.get(w) or self.known[w] for w in words]
        for word, entry in fresh.items():
            if len(word) <= MAX_UNIT_CHARS and len(self.known) < MAX_UNITS:
                self.known[word] = (tuple(entry[0]), tuple(entry[1]), entry[2])
        return found


@cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Read once in each worker."""
    return Tokenizers(a_path, b_path)


def _gathered(entries: list, side: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``entries`` in the order of ``codes``, and how many each code has."""
    sizes = np.fromiter((len(e[side]) for e in entries), np.int64, len(entries))
    flat = np.fromiter(chain.from_iterable(e[side] for e in entries), np.int64, int(sizes.sum()))
    starts, counts = np.cumsum(sizes) - sizes, sizes[codes]
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts[codes] - before, counts) + np.arange(int(counts.sum()))], counts


def encoded(texts: list[str | None], coders: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, ids_a, n_a, ids_b, n_b): token ids, documents in the given order of their places.

    Texts that are null or empty, or that the tokens do not give back, have no tokens.
    """
    places = np.asarray([i for i, t in enumerate(texts) if t], np.int64)
    lists = pc.split_pattern(pa.array([texts[i] for i in places], pa.large_string()), " ")
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    words = lists.flatten().dictionary_encode()
    names, codes = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
    # an empty word is a run of spaces; white space before the next space belongs to one run with it
    odd_name = np.asarray([not w or w[-1].isspace() or w[0].isspace() for w in names], bool)
    entries = coders.units([w for w, odd in zip(names, odd_name, strict=True) if not odd])
    back = iter(entries)
    entries = [((), (), False) if odd else next(back) for odd in odd_name]
    bad = np.asarray([not e[2] for e in entries], bool)
    word_bad = np.concatenate([[0], np.cumsum(bad[codes])])
    odd_doc = word_bad[ends[1:]] > word_bad[ends[:-1]]
    plain = np.repeat(~odd_doc, np.diff(ends))
    sides = []
    for side in (0, 1):
        ids, counts = _gathered(entries, side, codes[plain])
        total = np.concatenate([[0], np.cumsum(counts)])
        stops = np.concatenate([[0], np.cumsum(np.diff(ends)[~odd_doc])])
        sides.append([ids, np.diff(total[stops])])
    order = [places[~odd_doc]]
    if odd_doc.any():
        again = coders.whole([texts[i] for i in places[odd_doc]])
        for side in (0, 1):
            kept = [e[side] if e[2] else () for e in again]
            sides[side][0] = np.concatenate([sides[side][0], np.fromiter(chain.from_iterable(kept), np.int64)])
            sides[side][1] = np.concatenate([sides[side][1], np.asarray([len(k) for k in kept], np.int64)])
        order.append(places[odd_doc])
    return np.concatenate(order), sides[0][0], sides[0][1], sides[1][0], sides[1][1]


def _marks(ends: np.ndarray, total: int) -> np.ndarray:
    """Whether a token ends at each byte offset from 0 to ``total``, counted in windows."""
    out = np.zeros(total + 1, bool)
    for start in range(0, total + 1, WINDOW):
        i, j = np.searchsorted(ends, [start, start + WINDOW])
        stop = min(total + 1, start + WINDOW)
        out[start:stop] = np.bincount(ends[i:j] - start, minlength=stop - start) > 0
    return out


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``counts`` values, by differences of a prefix sum."""
    running = np.concatenate([[0], np.cumsum(values)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return running[ends[1:]] - running[ends[:-1]]


class Alignment:
    """Groups of tokens between common ends, over a whole batch of documents."""

    def __init__(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, coders: Tokenizers) -> None:
        self.ids, self.n_tokens = (ids_a, ids_b), (n_a, n_b)
        ends_a, ends_b = np.cumsum(coders.sizes_a[ids_a]), np.cumsum(coders.sizes_b[ids_b])
        total = int(ends_a[-1]) if len(ends_a) else 0
        both = _marks(ends_a, total)
        both &= _marks(ends_b, total)
        both[0] = False
        cut = np.cumsum(both, dtype=np.int64)
        self.group = (cut[ends_a - 1], cut[ends_b - 1])
        n = int(cut[-1])
        self.sizes = tuple(np.bincount(g, minlength=n) for g in self.group)
        doc_ends = np.concatenate([[0], np.cumsum(n_a)])
        last = np.concatenate([[0], ends_a])[doc_ends]
        self.n_groups = np.diff(cut[last]) if total else np.zeros(len(n_a), np.int64)
        self.n_links = _sums(self.sizes[0] * self.sizes[1], self.n_groups)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text, '' without tokens."""
        a, b = self.group
        na, nb = self.sizes
        before_b, up_to_a = np.cumsum(nb) - nb, np.cumsum(na)
        n = len(a) + len(b)
        rows = np.zeros((n, 8), np.uint8)
        at_a, at_b = np.arange(len(a)) + before_b[a], np.arange(len(b)) + up_to_a[b]
        for at, ids in ((at_a, self.ids[0]), (at_b, self.ids[1])):
            rows[at, :7] = _digits(int(ids.max(initial=0)))[ids]
        rows[at_a, 7] = np.where(np.append(a[1:] != a[:-1], True)[: len(a)], ord("|"), ord(","))
        rows[at_b, 7] = np.where(np.append(b[1:] != b[:-1], True)[: len(b)], ord(";"), ord(","))
        tokens = self.n_tokens[0] + self.n_tokens[1]
        stops = np.cumsum(tokens)
        rows[stops[tokens > 0] - 1, 7] = 0
        used = rows != 0
        widths = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        text = memoryview(np.ascontiguousarray(rows[used]))
        return [hashlib.sha256(text[widths[stop - count] : widths[stop]]).hexdigest() if count else "" for stop, count in zip(stops.tolist(), tokens.tolist(), strict=True)]

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct (document, a, b) as one number, and how many links each has."""
        a, b = self.group
        fan = self.sizes[1][a]
        doc = np.repeat(np.arange(len(self.n_tokens[0])), self.n_tokens[0])
        first = (np.cumsum(self.sizes[1]) - self.sizes[1])[a]
        base = doc * (len_a := int(self.ids[0].max(initial=0)) + 1) + self.ids[0]
        running = np.cumsum(fan)
        keys, counts, start = [], [], 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(running, (running[start - 1] if start else 0) + LIST_LINKS, "right")))
            n = fan[start:stop]
            place = np.arange(int(n.sum())) + np.repeat(first[start:stop] - (np.cumsum(n) - n), n)
            key, count = np.unique(np.repeat(base[start:stop], n) * size_b + self.ids[1][place], return_counts=True)
            keys.append(key)
            counts.append(count)
            start = stop
        if len(keys) > 1:
            every, which = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts = [every], [np.bincount(which, np.concatenate(counts)).astype(np.int64)]
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc, token_b = keys[0] // size_b, keys[0] % size_b
        return doc // len_a, (doc % len_a << ID_BITS) | token_b, counts[0]


@cache
def _digits(most: int) -> np.ndarray:
    """Decimal digits of 0 to ``most``, at the right, behind zero bytes."""
    ids = np.arange(most + 1)
    out = np.zeros((most + 1, 7), np.uint8)
    for place in range(7):
        power = 10**place
        out[:, 6 - place] = np.where((ids >= power) | (place == 0), 48 + ids // power % 10, 0)
    return out


def _chunk_row(chunk: int, docs: list[pa.Table], own: list[tuple]) -> pd.DataFrame:
    """A chunk: its documents' figures, its distinct pairs, and which of them each document has how often."""
    table = pa.concat_tables(docs).combine_chunks()
    codes = np.concatenate([o[0] for o in own]) if own else np.zeros(0, np.int64)
    keys, which = np.unique(codes, return_inverse=True)
    times = np.concatenate([o[1] for o in own]) if own else codes
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_table(table)
    return pd.DataFrame({"chunk": [chunk], "docs": [sink.getvalue().to_pybytes()], "which": [pack(np.diff(which, prepend=0))], "times": [pack(times)], "keys": [pack(np.diff(keys, prepend=0))], "holders": [pack(np.bincount(which, minlength=len(keys)))]})


def _aligned(batches: Iterator[pd.DataFrame], a_path: str, b_path: str, chunk_pairs: int) -> Iterator[pd.DataFrame]:
    coders = tokenizers(a_path, b_path)
    size_b = len(coders.bytes_b)
    chunk, docs, own, held = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for part in bounded_slices(batch, chars=SLICE_CHARS):
            texts = [t if isinstance(t, str) else None for t in part["text"]]
            order, *tokens = encoded(texts, coders)
            found = Alignment(*tokens, coders)
            doc, codes, times = found.pairs(size_b)
            n_pairs = np.bincount(doc, minlength=len(order))
            rest = np.setdiff1d(np.arange(len(texts)), order)
            every = np.concatenate([order, rest])
            figures = [found.n_tokens[0], found.n_tokens[1], found.n_groups, found.n_links, n_pairs]
            table = {"doc_id": pa.array(part["doc_id"].iloc[every].astype("Int64"), pa.int64())}
            table |= {name: pa.array(np.concatenate([f, np.zeros(len(rest), np.int64)]), pa.int64()) for name, f in zip(["n_a", "n_b", "n_groups", "n_links", "n_pairs"], figures, strict=True)}
            table["groups_sha256"] = pa.array(found.digests() + [""] * len(rest))
            docs.append(pa.table(table))
            own.append((codes, times))
            held += len(codes) + len(texts)
            if held >= chunk_pairs:
                yield _chunk_row(chunk, docs, own)
                chunk, docs, own, held = chunk + 1, [], [], 0
    if docs:
        yield _chunk_row(chunk, docs, own)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each distinct pair of each chunk."""
    for batch in batches:
        for chunk, keys, holders in batch.itertuples(index=False):
            codes, docs = np.cumsum(unpack(keys, np.int64)), unpack(holders, np.int64)
            for i in range(0, len(codes), 100_000):
                yield pd.DataFrame({"pair": codes[i : i + 100_000], "chunk": chunk, "docs": docs[i : i + 100_000]})


def _finished(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk with what the corpus says of their pairs."""
    order = np.argsort(told["pair"].to_numpy(), kind="stable")
    count, best = told["count"].to_numpy()[order], told["best"].to_numpy()[order]
    out = []
    for docs, which, times in zip(chunk["docs"], chunk["which"], chunk["times"], strict=True):
        table = opened(docs).to_pandas(integer_object_nulls=True)
        which, times = np.cumsum(unpack(which, np.int64)), unpack(times, np.int64)
        n = table["n_pairs"].to_numpy()
        out.append(table.drop(columns="n_pairs").assign(n_best=_sums(times * best[which], n), count_sum=_sums(times * count[which], n)))
    found = pd.concat(out)
    return found.assign(doc_id=found["doc_id"].astype("Int64"))[[c.split()[0] for c in RESULT_SCHEMA.split(", ")]]


def align(docs: DataFrame, a_path: str, b_path: str, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """How the tokens of two tokenizers meet in every document.

    ``a_path`` is a byte-level BPE file that encodes a space and the text, ``b_path`` a
    piece model that adds the space itself. Takes doc_id and text; other columns are
    ignored. Returns one row for each input row, repeated and null ids included: n_a and
    n_b tokens, n_groups between ends of both, n_links pairs of tokens within a group,
    n_best of them whose count is the highest of their A id, count_sum of the links'
    counts, groups_sha256. A pair's count is the number of input rows that hold it linked.
    Texts that are null, empty or that either tokenizer does not give back have no tokens:
    zeros and ''. An empty table gives an empty one.

    Chunks of documents list each pair once and ask for its count by a plain join, so a
    pair that every document holds is one row a chunk. A chunk holds ``chunk_pairs``
    entries, and is larger only by its last slice.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialize(rows.mapInPandas(lambda it: _aligned(it, a_path, b_path, chunk_pairs), "chunk long, docs binary, which binary, times binary, keys binary, holders binary"), "aligned")
    listed = materialize(chunks.select("chunk", "keys", "holders").mapInPandas(_listed, "pair long, chunk long, docs long"), "pairs")
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", ID_BITS))
    # an id of the first tokenizer has as many pairs as the second has ids, at most
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    told = listed.select("pair", "chunk").join(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair")
    return chunks.select("chunk", "docs", "which", "times").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_finished, RESULT_SCHEMA)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by the two public tokenizers of the contract."""
    import public_tokenizers

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}
