"""Documents in chunks that ask buckets about their n-grams.

A chunk is one row with the texts of some megabytes. It asks once for each of its distinct
n-grams, so a common one is asked for once a chunk and not once a word. Questions are
dealt by ranges of the n-gram's hash into buckets, whose number grows with the corpus; a
bucket adds up what all chunks say of its n-grams and answers each, and the answers meet
the chunk again. No table of n-grams is ever held whole or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, materialize

#: Characters of the texts of a chunk, and of the text whose n-grams make a bucket on average.
CHUNK_CHARS, BUCKET_CHARS = 4_000_000, 16_000_000
#: Buckets at least, so that a small corpus is spread as well.
MIN_BUCKETS = 64

QUESTION_SCHEMA = "chunk long, kind int, bucket int, keys binary, said binary"


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed; small ones take little room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def chunked(rows: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, body): ``rows`` (any columns and a binary ``text``) in parts of about ``chars`` bytes of text, written out.

    Every row is in one chunk; a chunk is larger only by its last text.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy() + 16)
            start = 0
            while start < len(ends):
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + chars - size, "right")))
                held.append(batch.slice(start, stop - start))
                size += ends[stop - 1] - before
                start = stop
                if start < len(ends) or size >= chars:
                    yield packed(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield packed(chunk, held)

    def packed(chunk: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(pa.Table.from_batches(parts).combine_chunks())
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    bounded_batches(rows.sparkSession)
    return materialize(rows.mapInArrow(deal, "chunk long, body binary"), "chunks")


def opened(body: bytes) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(bytes(body)).read_all()


def bucket_count(chars: int, per_bucket: int = BUCKET_CHARS) -> int:
    return max(MIN_BUCKETS, -(-chars // per_bucket))


def _bucket(keys: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """Bucket of keys of ``width`` bits; sorted keys have sorted buckets."""
    return (((keys >> np.uint64(width - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def key_counts(keys: np.ndarray, width: int, buckets: int) -> list[int]:
    """How many of the keys each bucket is asked for, without those that are asked for none."""
    counts = np.bincount(_bucket(keys, width, buckets), minlength=buckets)
    return counts[counts > 0].tolist()


def asked(chunks: DataFrame, ask: Callable[[pa.Table], Iterator[tuple[int, np.ndarray, Callable]]], width: int, buckets: int) -> DataFrame:
    """The questions of all chunks, a row for each bucket that a chunk asks.

    ``ask`` yields (kind, keys, said): sorted distinct keys of ``width`` bits (32 at
    least), and what the chunk says of the keys from i to j, as bytes.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, body in batch.itertuples(index=False):
                for kind, keys, said in ask(opened(body)):
                    cut = np.searchsorted(_bucket(keys, width, buckets), np.arange(buckets + 1)).tolist()
                    out = [(chunk, kind, b, pack(np.diff(keys[i:j], prepend=np.uint64(0))), said(i, j)) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
                    if out:
                        yield pd.DataFrame(out, columns=["chunk", "kind", "bucket", "keys", "said"])

    return chunks.mapInPandas(rows, QUESTION_SCHEMA)


def answered(questions: DataFrame, answer: Callable[[int, np.ndarray, list[int], list[bytes]], Iterator[tuple[bytes, list | None]]]) -> DataFrame:
    """(chunk, kind, bucket, answer, stats) for each question.

    ``answer(kind, which, ends, said)`` gets the place of each asked key among the
    distinct keys of the bucket, all chunks in a row and each up to its entry of
    ``ends``, and what each said; it yields an answer for each chunk and, with one of
    them, sums over the bucket, if any.
    """

    def rows(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unpack(raw, np.uint64), dtype=np.uint64) for raw in group["keys"]]
        which = np.unique(np.concatenate(keys), return_inverse=True)[1]
        found = [*answer(int(group["kind"].iloc[0]), which, np.cumsum([len(k) for k in keys]).tolist(), list(group["said"]))]
        return group[["chunk", "kind", "bucket"]].assign(answer=[a for a, _ in found], stats=[s for _, s in found])

    return materialize(questions.groupBy("kind", "bucket").applyInPandas(rows, "chunk long, kind int, bucket int, answer binary, stats array<long>"), "answers")


def met(chunks: DataFrame, answers: DataFrame, work: Callable[[pa.Table, dict[int, list[bytes]]], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work`` on each chunk and its answers, by kind in the order of the keys."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(chunk: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        by_kind = {kind: part.sort_values("bucket")["answer"].tolist() for kind, part in own.groupby("kind")}
        found = [work(opened(body), by_kind) for body in chunk["body"]]
        found = [f for f in found if f is not None]
        return pd.concat(found)[columns] if found else pd.DataFrame({c: [] for c in columns})

    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "kind", "bucket", "answer").groupBy("chunk")).applyInPandas(rows, schema)


def characters(rows: DataFrame) -> int:
    """Bytes of all texts."""
    return rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
