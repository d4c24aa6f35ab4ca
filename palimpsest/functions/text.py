"""Text functions: normalising, JSON, escaping and truncation.

What built-in expressions can say is a Column function; the rest is an Arrow UDF.
Redaction and scanning are in ``secrets``.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.secrets import MAX_TEXT, SECRET_ID, checked, entropy, is_secret_name, kind_of, marker, redact, redact_and_scan, redact_text, scan, scan_text, secret_name

__all__ = ["MAX_TEXT", "SECRET_ID", "checked", "entropy", "redact", "redact_and_scan", "redact_text", "scan", "scan_text", "secret_name"]

#: Characters that no normal form changes on their own: the rest goes to Python.
_STABLE_NFKC = "[^\\x00-\\x7F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u00FF\\u2012-\\u2015\\u2018-\\u201E]"
_STABLE_NFC = "[^\\x00-\\u02FF\\u2010-\\u2027\\u2030-\\u205E\\u20A0-\\u20BF]"


def strip_controls(text: Column) -> Column:
    """Line ends become newlines, other control characters spaces; zero-width ones and byte order marks go."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[\p{Cc}&&[^\n]]", " "), "[\\u200B-\\u200D\\uFEFF]", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.udf(T.StringType(), useArrow=True)
def _nfkc(text):
    return None if text is None else unicodedata.normalize("NFKC", text)


@F.udf(T.StringType(), useArrow=True)
def _nfc(text):
    return None if text is None else unicodedata.normalize("NFC", text)


def normalize_nfkc(text: Column) -> Column:
    """Compatibility form; texts without a character that it may change stay in the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(_STABLE_NFKC), text)), text)


def normalize_nfc(text: Column) -> Column:
    """Composed form, likewise."""
    return F.coalesce(_nfc(F.when(text.rlike(_STABLE_NFC), text)), text)


@F.pandas_udf(T.DoubleType())
def token_entropy(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: entropy(t) if isinstance(t, str) else None)


def redact_json_text(text: str | None, limit: int = 10_000, depth: int = 256) -> str | None:
    """A strict JSON text with the values of secret-named keys replaced; None if it is no such JSON or too large."""
    nodes = 0

    def walk(value, level):
        nonlocal nodes
        nodes += 1
        if nodes > limit or level > depth:
            raise ValueError("too large")
        if isinstance(value, dict):
            return {k: marker(kind_of(k)) if is_secret_name(k) else walk(v, level + 1) for k, v in value.items()}
        return [walk(v, level + 1) for v in value] if isinstance(value, list) else value

    try:
        return json.dumps(walk(strict_json(text), 0), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, TypeError, RecursionError):
        return None


def strict_json(text: str):
    """Parsed JSON; repeated keys, prototype keys and non-finite numbers are errors."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys) or {"__proto__", "constructor", "prototype"} & set(keys):
            raise ValueError("repeated or reserved key")
        return dict(items)

    def refuse(name):
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


@F.pandas_udf(T.StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    return texts.map(redact_json_text)


def escape_field(text: Column) -> Column:
    """Text in which the delimiters of the memory block cannot be closed, nor what looks like them."""
    for pattern, shown in ((r"(?i)</memory-context", r"<\\/memory-context"), (r"(?i)<memory-context", r"<\\memory-context"), (r"(?i)<\s*/\s*memory-context\b", "&lt;/memory-context"), (r"(?i)<\s*memory-context\b", "&lt;memory-context")):
        text = F.regexp_replace(text, pattern, shown)
    return text


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(max(limit - 1, 0))), F.lit("…"))).otherwise(text)


def fingerprint(text: Column) -> Column:
    """The start of a hash of the composed text."""
    return F.substring(F.sha2(normalize_nfc(text).cast("binary"), 256), 1, 32)


def is_prompt(text: Column) -> Column:
    """Natural-language prompts: not blank and no command."""
    return F.coalesce((F.trim(text) != "") & ~F.ltrim(text).startswith("/"), F.lit(False))


def provenance(project: Column, kind: Column, system: Column, scope: Column, valid_from: Column, policy_epoch: Column, evidence: Column, score: Column, most: int = 512) -> Column:
    """The label of a hit: its fields in fixed order, escaped and bounded; null fields are unknown or left out."""
    field = lambda c: truncate(F.coalesce(F.when(c != "", escape_field(c)), F.lit("unknown")), most)
    given = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}="), field(c.cast("string"))))
    always = lambda label, c: F.concat(F.lit(f"{label}="), field(c.cast("string")))
    return F.concat_ws(", ", always("project", project), always("type", kind), always("system", system), given("scope", scope), given("valid_from", valid_from), given("policy_epoch", policy_epoch), F.concat(F.lit("evidence_count="), F.least(F.lit(1024), evidence).cast("string")), always("score", score))


def escape_line(text: Column) -> Column:
    """A field that cannot end its line or its fence."""
    fence = F.regexp_replace(F.regexp_replace(text, r"(?i)<\s*/\s*untrusted-data\b", r"<\\\\/untrusted-data"), r"(?i)<(\s*untrusted-data\b[^>]*)>", "&lt;$1&gt;")
    plain = F.regexp_replace(fence, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")
    return F.replace(F.replace(plain, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def prompts(episodes: DataFrame, group: str, head: str, budget: int, most_members: int = 1024, most_text: int = 4000) -> DataFrame:
    """(group, n, prompt, error): the fenced prompt of each group's episodes in id order.

    Lines hold escaped, bounded fields. A group of more members than a job may have, or
    whose prompt has more bytes than the budget, is refused: nothing is cut to fit.
    """
    line = F.concat_ws("\n", F.concat(F.lit("id:"), escape_line(F.col("id"))), F.concat(F.lit("event:"), escape_line(F.col("event_kind"))), F.concat(F.lit("at:"), F.col("event_at").cast("string")), F.concat(F.lit("text:"), escape_line(F.left("text", F.lit(most_text)))))
    sized = episodes.select(group, "id", line.alias("_line"))
    sizes = sized.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_line") + 1).alias("_bytes"))
    fits = sizes.filter((F.col("n") <= most_members) & (F.col("_bytes") <= budget))
    lines = sized.join(fits.select(group), group, "left_semi").groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", "_line")))["_line"], "\n").alias("_body"))
    whole = F.concat(F.lit(f"{head}\n<untrusted-data>\n"), "_body", F.lit("\n</untrusted-data>"))
    out = sizes.join(lines, group, "left").withColumn("_whole", whole)
    good = F.octet_length("_whole") <= budget
    return out.select(group, "n", F.when(good, F.col("_whole")).alias("prompt"), F.when(~F.coalesce(good, F.lit(False)), "over budget").alias("error"))
