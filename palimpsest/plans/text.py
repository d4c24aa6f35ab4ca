"""Redaction, scanning and other text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.registry import query
from palimpsest.sources import records as rec
from palimpsest.sources.records import EPISODES, OBSERVATIONS, table, with_


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\x00-\x09\x0B-\x1F\x7F-\x9F]', ' ', 'g'), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"


@query("x2_strip_controls", f"SELECT doc_id, {_PLAIN.format('text')} AS text FROM documents")
def x2_strip_controls(spark, sf_dir):
    """Line ends, control characters and zero-width ones."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_controls(F.col("text")).alias("text"))


#: The one kind of field that the tables hold; other kinds, addresses and tokens are in the tests' goldens.
_TOKEN_FIELD = r"""regexp_replace({0}, '(?i)\b(token)\s*(?::|=)\s*(?:Bearer\s+)?(?:"[^"]*"|''[^'']*''|\[[^\]\n]{{1,200}}\]|<[^>\n]{{1,200}}>|[^\s,;}}\]\n]+)', '\1: [token redacted]', 'g')"""
_REDACTED = "left(" + _TOKEN_FIELD.format(_PLAIN.format("nfc_normalize(text)")) + ", 16000)"


@query("x7_redact", f"SELECT doc_id, t AS text, CASE WHEN t = '' THEN 'dropped' WHEN t = text THEN 'unchanged' ELSE 'redacted' END AS status FROM (SELECT doc_id, text, {_REDACTED} AS t FROM documents)")
def x7_redact(spark, sf_dir):
    """All redactions in order, and whether a text changed."""
    docs = table(spark, sf_dir, "documents")
    done = tx.redact(F.col("text"))
    return docs.select("doc_id", done.alias("text"), F.when(done == "", "dropped").when(done == F.col("text"), "unchanged").otherwise("redacted").alias("status"))


@query("x6_redact_assignments", r"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'a my_password: [password redacted], b' WHEN 1 THEN 'apiKey: [api_key redacted] x' WHEN 2 THEN '"clientSecret": "[secret redacted]"' WHEN 3 THEN 'monkey=banana' WHEN 4 THEN 'password=[redacted]'
  WHEN 5 THEN 'Authorization: [authorization redacted]' WHEN 6 THEN 'setCookie: [cookie redacted]; path' WHEN 7 THEN '{"k":1,"refreshToken":"[token redacted]","z":[{"passwd":"[password redacted]"}]}' ELSE 'token budget is 2000' END AS text FROM events""")
def x6_redact_assignments(spark, sf_dir):
    """Secret-named values in assignments, headers, quoted fields and JSON."""
    raw = ["a my_password = 'hunter2 x', b", "apiKey:abcdef123 x", "\"clientSecret\": \"s\"", "monkey=banana", "password=[redacted]", "Authorization: Bearer abc", "setCookie=abc; path", "{\"k\":1,\"refreshToken\":\"x\",\"z\":[{\"passwd\":{\"a\":2}}]}", "token budget is 2000"]
    text = F.element_at(F.array(*map(F.lit, raw)), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", tx.redact(text).alias("text"))


_WORDS = "authorization|cookie|setcookie|apikey|accesstoken|authtoken|bearer|password|passwd|secret|credential|credentials|privatekey|token"


@query("x9_sensitive_names", rf"""SELECT name, coalesce(joined = 'key' OR regexp_matches(joined, '({_WORDS})$') OR regexp_matches(parts, '(^|[^a-z0-9])({_WORDS}|key)($|[^a-z0-9])'), false) AS sensitive
FROM (SELECT name, parts, regexp_replace(parts, '[^a-z0-9]', '', 'g') AS joined FROM (SELECT name, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS parts FROM (
  SELECT DISTINCT unnest([word, word || 'Key', 'my_' || word || '-token', word || 'Passwd2', 'set' || word || 'Cookie', word || 'Secrets']) AS name FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS word FROM benchmark))))""")
def x9_sensitive_names(spark, sf_dir):
    """Which names mark a secret, alone or in compounds of any case style."""
    word = F.col("word")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_]+)"), F.lit(1))).alias("word")).distinct()
    names = words.select(F.explode(F.array(word, F.concat(word, F.lit("Key")), F.concat(F.lit("my_"), word, F.lit("-token")), F.concat(word, F.lit("Passwd2")), F.concat(F.lit("set"), word, F.lit("Cookie")), F.concat(word, F.lit("Secrets")))).alias("name")).distinct()
    return names.select("name", tx.secret_name(F.col("name")).alias("sensitive"))


@query("x10_truncate", "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 119) || '…' ELSE text END AS head, right(text, 100) AS tail FROM documents")
def x10_truncate(spark, sf_dir):
    """Bounded heads and tails."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate(F.col("text"), 120).alias("head"), F.right("text", F.lit(100)).alias("tail"))


_ENTROPY = "list_sum(list_transform(map_values(list_histogram(string_split(c, ''))), lambda k: -CAST(k AS DOUBLE) / length(c) * log2(CAST(k AS DOUBLE) / length(c))))"
_DENSE = rf"""len(list_filter(regexp_extract_all({{0}}, '[A-Za-z0-9+/_-]{{{{24,}}}}'), lambda c: regexp_matches(c, '[A-Za-z]') AND NOT regexp_full_match(lower(c), '[0-9a-f]{{{{8}}}}-([0-9a-f]{{{{4}}}}-){{{{3}}}}[0-9a-f]{{{{12}}}}|[0-9a-f]{{{{40}}}}|[0-9a-hjkmnp-tv-z]{{{{26}}}}')
  AND ((regexp_matches(c, '[0-9]') AND {_ENTROPY} >= 3.0) OR (regexp_full_match(c, '[A-Za-z]+') AND regexp_matches(c, '[a-z]') AND regexp_matches(c, '[A-Z]') AND {_ENTROPY} >= 4.6)))) > 0"""
_SCANNED = rf"""CASE WHEN regexp_matches({{0}}, '(^|[^A-Za-z0-9_-])sk-(proj-)?[A-Za-z0-9_-]{{{{16,}}}}($|[^A-Za-z0-9_-])|(^|[^A-Z0-9])(AKIA|ASIA)[A-Z0-9]{{{{16}}}}($|[^A-Z0-9])|-----BEGIN [A-Z ]*PRIVATE KEY-----')
  OR len(list_filter(regexp_extract_all({{0}}, '(?i)\btoken\s*(?::|=)\s*(?:Bearer\s+)?([^\r\n]*?)(?:\s+[A-Za-z][A-Za-z0-9_.-]{{{{1,80}}}}\s*(?::|=)|$)', 1), lambda v: NOT regexp_full_match(trim(v), '\*{{{{3,}}}}|<redacted>'))) > 0
  OR {_DENSE} THEN 'rejected' ELSE 'passed' END"""


@query("x11_scan", f"SELECT doc_id, {_SCANNED.format('text')} AS verdict, {_SCANNED.format('t')} AS verdict_after FROM (SELECT doc_id, text, replace({_REDACTED}, '[token redacted]', '<redacted>') AS t FROM documents)")
def x11_scan(spark, sf_dir):
    """X11, AD8, C14: whether each text may be stored as it is, and after redaction."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.scan(F.col("text")).alias("verdict"), tx.scan(tx.redact(F.col("text"))).alias("verdict_after"))


@query("x13_escape", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?i)</memory-context', '<\\/memory-context', 'g'), '(?i)<memory-context', '<\\memory-context', 'g'), '(?i)<\s*/\s*memory-context\b', '&lt;/memory-context', 'g'), '(?i)<\s*memory-context\b', '&lt;memory-context', 'g') AS html FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '</Memory-Context>' WHEN 1 THEN '<memory-context x>' WHEN 2 THEN '< / MEMORY-CONTEXT>' WHEN 3 THEN '<  memory-context y' ELSE '<memory' END || html AS h FROM pages)")
def x13_escape(spark, sf_dir):
    """Delimiters that a text cannot close, and what looks like them."""
    k = F.col("page_id") % 5
    start = F.when(k == 0, "</Memory-Context>").when(k == 1, "<memory-context x>").when(k == 2, "< / MEMORY-CONTEXT>").when(k == 3, "<  memory-context y").otherwise("<memory")
    return table(spark, sf_dir, "pages").select("page_id", tx.escape_field(F.concat(start, "html")).alias("html"))


@query("x15_collapse", "SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def x15_collapse(spark, sf_dir):
    """White space collapsed."""
    return table(spark, sf_dir, "benchmark").select("item_id", tx.collapse_spaces(F.col("text")).alias("text"))


@query("a14_entropy", "SELECT token, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT token, c, count(*) / any_value(length(token)) AS p FROM (SELECT token, unnest(string_split(token, '')) AS c FROM (SELECT DISTINCT event_type AS token FROM events)) GROUP BY token, c) GROUP BY token")
def a14_entropy(spark, sf_dir):
    """Shannon entropy of tokens."""
    tokens = table(spark, sf_dir, "events").select(F.col("event_type").alias("token")).distinct()
    chars = tokens.select("token", F.explode(F.split("token", "")).alias("c")).filter("c <> ''")
    shares = chars.groupBy("token", "c").agg((F.count(F.lit(1)) / F.first(F.length("token"))).alias("p"))
    return shares.groupBy("token").agg((F.round(-F.sum(F.col("p") * F.log2("p")), 6) + 0.0).alias("entropy"))


@query("x1_normalize", "SELECT doc_id, nfc_normalize(text || ' e' || chr(769)) AS text FROM documents")
def x1_normalize(spark, sf_dir):
    """Composed Unicode (the compatibility form is part of f8_exact_terms)."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_nfc(F.concat("text", F.lit(" e\u0301"))).alias("text"))


@query("x5_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def x5_json_fields(spark, sf_dir):
    """Fields of a JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("x5_redact_json", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"a":[{"user_password":"[password redacted]"}],"apiKey":"[api_key redacted]","b":2}' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN '[1,{"k":"v"}]' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS props FROM events""")
def x5_redact_json(spark, sf_dir):
    """Strict JSON with secret values replaced; repeated or reserved keys and broken texts are refused."""
    k = F.col("event_id") % 6
    text = F.when(k == 0, '{"apiKey":"x","a":[{"user_password":1}],"b":2}').when(k == 1, '{"a":1,"a":2}').when(k == 2, '{"__proto__":1}').when(k == 3, "{").when(k == 4, '[1,{"k":"v"}]').otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", tx.redact_json(text).alias("props"))


@query("x25_labels", with_(OBSERVATIONS) + "SELECT id, concat_ws(', ', 'project=' || CASE WHEN scope = 'project' THEN project_id ELSE 'unknown' END, 'type=curated_memory', 'system=alpha', 'scope=' || scope, 'valid_from=' || strftime(make_timestamp(effective_at * 1000), '%Y-%m-%dT%H:%M:%S.%gZ'), 'policy_epoch=1', 'evidence_count=1', 'score=' || CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE '0.5' END) AS label FROM observations")
def x25_labels(spark, sf_dir):
    """Provenance labels in their fixed order; what is missing is unknown or left out."""
    from palimpsest.functions.instants import canonical

    o = rec.observations(spark, sf_dir).withColumns({"project_label": F.when(F.col("scope") == "project", F.col("project_id")), "score": F.when(F.col("event_id") % 4 != 0, "0.5"), "valid_from": canonical(F.col("effective_at"))})
    return o.select("id", tx.provenance(project=F.col("project_label"), kind=F.lit("curated_memory"), system=F.lit("alpha"), scope=F.col("scope"), valid_from=F.col("valid_from"), policy_epoch=F.col("policy_epoch"), evidence=F.lit(1), score=F.col("score")).alias("label"))


_LINE = r"""'id:' || id || chr(10) || 'event:' || event_kind || chr(10) || 'at:' || event_at || chr(10) || 'text:' || replace(replace(regexp_replace(left(text, 4000), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), chr(13), '\r'), chr(10), '\n')"""
_HEAD = "Memory curation request. Extract durable, factual items from the untrusted data below.\nReply with one strict JSON object only."


@query("x24_prompt", with_(EPISODES, f"p AS (SELECT session_id, count(*) AS n, '{_HEAD}' || chr(10) || '<untrusted-data>' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY id) || chr(10) || '</untrusted-data>' AS prompt FROM episodes GROUP BY session_id)") + "SELECT session_id, n, CASE WHEN strlen(prompt) <= 3000 THEN prompt END AS prompt, CASE WHEN strlen(prompt) > 3000 THEN 'over budget' END AS error FROM p")
def x24_prompt(spark, sf_dir):
    """Fenced curation prompts of escaped lines, within a budget of bytes, or refused."""
    return tx.prompts(rec.episodes(spark, sf_dir), "session_id", _HEAD, 3000)
