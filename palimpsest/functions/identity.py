"""Content addressing: canonical JSON, hashes, deterministic ids and a seeded generator."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_number(x: float) -> str:
    """A number in the shortest form that reads back equal, written as JSON engines of browsers do."""
    if not math.isfinite(x):
        raise ValueError("not finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    mantissa, _, exponent = text.partition("e")
    if not exponent:
        if 0 < abs(x) < 1e-6:
            mantissa, exponent = f"{x:.17e}".split("e")
        else:
            return text
    power = int(exponent)
    if -7 < power < 21:
        return f"{x:.{max(0, len(mantissa.replace('.', '').lstrip('-')) - 1 - power)}f}"
    return f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa else mantissa}e{'+' if power > 0 else '-'}{abs(power)}"


def canonical_json(value) -> str:
    """JSON with sorted keys (integer-like keys first, by value) and no spaces; -0 is 0."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return canonical_number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        index = lambda k: k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1
        keys = sorted((k for k in value if index(k)), key=int) + sorted((k for k in value if not index(k)), key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    raise TypeError(type(value).__name__)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def uuid_from_digest(digest: Column) -> Column:
    """A version-5 style id from the first 16 bytes of a hex digest."""
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 19, 2), F.lit("-"), F.substring(digest, 21, 12))


def ids_json(ids: Column) -> Column:
    """A sorted array of plain ids as a canonical JSON list."""
    return F.concat(F.lit('["'), F.array_join(F.array_sort(F.array_distinct(ids)), '","'), F.lit('"]'))


def evidence_digest(ids: Column) -> Column:
    return F.sha2(ids_json(ids), 256)


def logical_id(kind: str, *parts: Column) -> Column:
    """A tagged id: the kind, and a hash of the parts as a canonical JSON list of strings."""
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.concat(F.lit('["'), F.concat_ws('","', *parts), F.lit('"]')), 256))


def retry_wait(key: str, attempts: int, base: int, most: int) -> int:
    """``coordination.retry_delay`` of one job, where state is kept a key at a time."""
    bounded = min(most, base * 2 ** min(30, max(0, attempts - 1)))
    share = int(sha256_hex(f'{{"attempts":{attempts},"jobId":"{key}"}}')[:8], 16) / 0xFFFFFFFF
    return max(1, min(most, int(bounded * (0.5 + share * 0.5))))


class Xoshiro:
    """The public-domain xoshiro128** generator, seeded by a hash of a text."""

    def __init__(self, seed: str) -> None:
        digest = hashlib.sha256(seed.encode()).digest()
        self.s = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]

    def uint32(self) -> int:
        s, mask = self.s, 0xFFFFFFFF
        turn = lambda x, k: (x << k | x >> 32 - k) & mask
        out = turn(s[1] * 5 & mask, 7) * 9 & mask
        t = s[1] << 9 & mask
        s[2] ^= s[0]
        s[3] ^= s[1]
        s[1] ^= s[2]
        s[0] ^= s[3]
        s[2] ^= t
        s[3] = turn(s[3], 11)
        return out

    def uniform(self) -> float:
        return self.uint32() / 2**32

    def below(self, n: int) -> int:
        limit = 2**32 // n * n
        while (x := self.uint32()) >= limit:
            pass
        return x % n
