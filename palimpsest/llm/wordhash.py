"""Vectorised 64-bit hashes of words and of windows of words, for whole batches of texts.

Words are runs of bytes other than space and the control characters from tab to
carriage return. All arithmetic is modulo 2**64; a hash depends on the bytes of the
words alone, so equal windows hash alike in any document, task or run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes hashed at a time; bounds the memory of the kernels whatever the text.
SLICE_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0xD1342543DE82EF95
_GRAM_BASE = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    is_word = np.ones(256, dtype=bool)
    is_word[list(SPACES)] = False
    n = 2 * SLICE_BYTES + 2
    powers = np.ones(n, dtype=np.uint64)
    powers[1:] = np.uint64(_WORD_BASE)
    inverse = np.ones(n, dtype=np.uint64)
    inverse[1:] = np.uint64(pow(_WORD_BASE, -1, 1 << 64))
    return codes, is_word, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


def _hash_slice(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a slice."""
    codes, is_word, powers, inverse = _tables()
    if len(data) + 1 > len(powers):  # one word longer than a slice
        n = len(data) + 1
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _WORD_BASE, np.uint64)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(_WORD_BASE, -1, 1 << 64), np.uint64)]))
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = is_word[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(codes[raw] * powers[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * inverse[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _STEP), starts, ends


@dataclass
class Words:
    """Word hashes of a batch of texts; text ``i`` has words ``first[i]`` to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def as_bytes(text, lower: bool = False) -> bytes:
    """UTF-8 bytes of a string, or bytes as they are; a null is empty; ``lower`` folds A-Z only."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text if isinstance(text, bytes) else b""
    return data.lower() if lower else data


def _slices(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SLICE_BYTES:
        cut = max(data.rfind(bytes([s]), at + 1, at + SLICE_BYTES) for s in SPACES)
        if cut < 0:  # a word longer than a slice: up to the next white space
            cut = min((p for s in SPACES if (p := data.find(bytes([s]), at + SLICE_BYTES)) >= 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def hash_words(texts: Iterable, lower: bool = False) -> Words:
    """Word hashes of texts (strings, bytes or nulls). Texts are joined into slices of bounded size."""
    hashes, counts, held, sizes, room = [], [], [], [], 0

    def flush() -> None:
        nonlocal held, sizes, room
        if held:
            h, starts, _ = _hash_slice(b" ".join(held))
            ends = np.cumsum(np.asarray(sizes, dtype=np.int64) + 1)
            counts.append(np.diff(np.searchsorted(starts, np.concatenate([[0], ends]))))
            hashes.append(h)
            held, sizes, room = [], [], 0

    for text in texts:
        data = as_bytes(text, lower)
        if len(data) > SLICE_BYTES:
            flush()
            parts = [_hash_slice(part)[0] for part in _slices(data)]
            hashes.extend(parts)
            counts.append(np.asarray([sum(map(len, parts))]))
            continue
        if room + len(data) > SLICE_BYTES:
            flush()
        held.append(data)
        sizes.append(len(data))
        room += len(data) + 1
    flush()
    none = np.zeros(0, dtype=np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
    return Words(np.concatenate(hashes) if hashes else none, np.concatenate([[0], np.cumsum(n)]).astype(np.int64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; k - 1 fewer than words. Texts are not told apart."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _GRAM_BASE
        out += words[j : j + n]
    return mix(out)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out
