"""Byte-level BPE encoding and decoding by overlapping chunks.

The split pattern has no look-behind, so two scans that share one pre-token boundary
agree on every later boundary. A long text is therefore cut without a scan of the
whole: around each planned cut two scans start at different places, and the cut moves
to the first boundary that both reach. The pieces between cuts are dealt to tasks of
their own, encoded there, and put together again by document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a piece, and characters on each side of a cut that the scans may use.
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 1_024
SCHEMA = "doc_id long, n_tokens long, ids_le binary, decoded binary"


@cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, made once in each worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _scanner(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def cuts(text: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Places at which ``text`` may be cut so that pieces encode as the whole does.

    A cut lies at a boundary that a scan from before the planned place and a scan
    from the place itself both reach, with a character before it that is not white
    space, so that the look-ahead of the white-space rule never spans it. Where the
    scans do not meet in the overlap, the overlap is doubled; where they never meet,
    the piece runs on to the next planned place.
    """
    found, scan, at = [0], _scanner(pattern), chunk
    while at < len(text):
        reach, cut = overlap, None
        while cut is None:
            left, end = max(found[-1], at - reach), min(len(text), at + reach)
            ours = [m.end() for m in scan.finditer(text, left, end)]
            theirs = {m.end() for m in scan.finditer(text, at, end)}
            # the last boundary before the end of the scanned part may be an artefact
            cut = next((p for p in ours[:-1] if p > at and p in theirs and not text[p - 1].isspace()), None)
            if reach >= chunk or end == len(text):
                break
            reach *= 2
        if cut is not None:
            found.append(cut)
        at = max(at + chunk, found[-1] + chunk // 2)
    return [*found, len(text)]


def _encode(batches: Iterator[pd.DataFrame], ranks_path: str, pattern: str, keys: list[str]) -> Iterator[pd.DataFrame]:
    coder = encoding(ranks_path, pattern)
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.iloc[start : start + 256]
            ids, decoded, counts = [], [], []
            for text in part["text"]:
                tokens = coder.encode_ordinary(text if isinstance(text, str) else "")
                ids.append(np.asarray(tokens, dtype="<u4").tobytes())
                decoded.append(coder.decode_bytes(tokens))
                counts.append(len(tokens))
            yield pd.DataFrame({**{k: part[k].array for k in keys}, "n_tokens": counts, "ids_le": ids, "decoded": decoded})


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Token ids of every whole text, and the bytes that they decode to.

    Takes ``doc_id`` (long) and ``text``; other columns are ignored. Returns one row
    for each input row, repeated and null ids included: doc_id, n_tokens, ids_le (ids
    as little-endian unsigned 32-bit integers) and decoded (bytes). A null text counts
    as empty: no tokens, no bytes. An empty table gives an empty table. Texts of at
    most two chunks are encoded where they are read; only pieces of longer texts are
    shuffled, and a group of pieces is one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > 2 * chunk
    short = rows.filter(~is_long).mapInPandas(lambda it: _encode(it, ranks_path, pattern, ["doc_id"]), SCHEMA)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                ends = cuts(text, pattern, chunk, overlap)
                pieces = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                yield pd.DataFrame({"row": row, "doc_id": pd.array([None if pd.isna(doc) else int(doc)] * len(pieces), dtype="Int64"), "piece": range(len(pieces)), "text": pieces})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        return pd.DataFrame({"doc_id": group["doc_id"].iloc[:1].astype("Int64"), "n_tokens": [int(group["n_tokens"].sum())], "ids_le": [b"".join(group["ids_le"])], "decoded": [b"".join(group["decoded"])]})

    pieces = (
        rows.filter(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInPandas(split, "row long, doc_id long, piece int, text string")
        .repartition("row", "piece")
        .mapInPandas(lambda it: _encode(it, ranks_path, pattern, ["row", "doc_id", "piece"]), "row long, doc_id long, piece int, n_tokens long, ids_le binary, decoded binary")
    )
    return short.unionByName(pieces.groupBy("row").applyInPandas(join, SCHEMA))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    coded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
