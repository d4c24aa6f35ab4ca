"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logged conversations are often snapshots: each call logs the turns so far, so most of
the log repeats. A rolling hash of each prefix of turns finds conversations that are a
prefix of a longer one; an anti-join leaves the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turn numbers of one block. Blocks of a conversation go to different tasks.
BLOCK_TURNS = 1024
_KEYS = ["no_id", "cid", "block"]
_SUMS = ["s0", "s1", "s2", "s3"]


def _keyed(conversations: DataFrame) -> DataFrame:
    turn = F.col("turn").cast("long")
    return conversations.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"),
        F.coalesce(F.floor(turn / BLOCK_TURNS), F.lit(-(2**62))).alias("block"),
        turn.alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )


def _halves(*parts: Column) -> list[Column]:
    """Two 64-bit hashes as four non-negative numbers below 2**32, which sums can't overflow."""
    hashes = [F.xxhash64(F.lit(seed), *parts) for seed in (17, 91)]
    return [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(no_id, cid, position, n_turns, s0..s3): a rolling hash of the first turns, for each position.

    The hash of a prefix is the sum of the hashes of (position, role, text), 128 bits
    in four parts, so it is summed by blocks of turn numbers first and by blocks of a
    conversation after that; no task holds a whole conversation. Texts stay behind.
    """
    turns = _keyed(conversations)
    hashed = turns.select(*_KEYS, "turn", "role", "text", *[c.alias(f"h{i}") for i, c in enumerate(_halves(F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")))])
    # equal rows are equal turns, so ordering by hash after the turn number loses nothing
    in_block = Window.partitionBy(*_KEYS).orderBy("turn", "role", "h0", "h1", "h2", "h3")
    numbered = hashed.drop("text").withColumn("rank", F.row_number().over(in_block).cast("long"))
    before = Window.partitionBy("no_id", "cid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("no_id", "cid")
    offsets = turns.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")).select(*_KEYS, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("n_turns"))
    placed = numbered.join(offsets, _KEYS).withColumn("position", F.col("offset") + F.col("rank"))
    marked = placed.select(*_KEYS, "position", "n_turns", *[c.alias(s) for s, c in zip(_SUMS, _halves(F.col("position"), F.col("h0"), F.col("h1"), F.col("h2"), F.col("h3")), strict=True)])
    totals = marked.groupBy(*_KEYS).agg(*[F.sum(s).alias(f"t{s}") for s in _SUMS]).select(*_KEYS, *[F.coalesce(F.sum(f"t{s}").over(before), F.lit(0)).alias(f"t{s}") for s in _SUMS])
    so_far = Window.partitionBy(*_KEYS).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rolled = marked.select(*_KEYS, "position", "n_turns", *[F.sum(s).over(so_far).alias(s) for s in _SUMS])
    return rolled.join(totals, _KEYS).select("no_id", "cid", "position", "n_turns", *[(F.col(s) + F.col(f"t{s}")).alias(s) for s in _SUMS])


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(no_id, cid) of conversations that are not a prefix of a longer one.

    Of conversations with the same turns, that with the smallest id stays; a null id
    comes last.
    """
    prefixes = prefix_hashes(conversations)
    key = ["position", *_SUMS]
    inner = prefixes.filter("position < n_turns").select(*key).distinct()
    finals = prefixes.filter("position = n_turns").groupBy(*key).agg(F.min(F.struct("no_id", "cid")).alias("keeper"))
    return finals.join(inner, key, "left_anti").select("keeper.no_id", "keeper.cid")


def render_chat(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as chat text.

    Takes conv_id, turn, role and text; other columns are ignored. Turns go by turn
    number, then role, then a hash of role and text, nulls first; repeated rows are
    turns of their own. Rows with a null conv_id are one conversation with a null id.
    A null role is "unknown", a null text is empty, and the marker "<|" within either
    is opened to "< |". Returns conv_id, part, n_turns and text: a part holds the turns
    of one block of turn numbers (null: its own part, first), so that no row grows
    without bound; a conversation of fewer turns than a block has one part, 0. An empty
    table gives no rows.
    """
    kept = maximal_conversations(conversations)
    open_up = lambda c, empty: F.replace(F.coalesce(c, F.lit(empty)), F.lit("<|"), F.lit("< |"))
    turns = _keyed(conversations).join(kept, ["no_id", "cid"], "left_semi")
    line = F.concat(F.lit("<|im_start|>"), open_up(F.col("role"), "unknown"), F.lit("\n"), open_up(F.col("text"), ""), F.lit("<|im_end|>\n"))
    order = _halves(F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    return (
        turns.select(*_KEYS, F.struct("turn", "role", *[c.alias(f"h{i}") for i, c in enumerate(order)], line.alias("line")).alias("turn"))
        .groupBy(*_KEYS)
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select(
            F.when(~F.col("no_id"), F.col("cid")).alias("conv_id"),
            F.when(F.col("block") > -(2**62), F.col("block")).alias("part"),
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.col("turns.line"), "").alias("text"),
        )
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat text of every maximal conversation."""
    return render_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op8_chat": op8_chat}
ORACLE_SQL = {
    "op8_chat": """
WITH s AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn) AS l, count(*) AS n FROM conversations GROUP BY conv_id
), kept AS (
  SELECT a.conv_id FROM s a
  WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.n > a.n AND list_slice(b.l, 1, a.n) = a.l)
    AND NOT EXISTS (SELECT 1 FROM s b WHERE b.l = a.l AND b.conv_id < a.conv_id)
)
SELECT c.conv_id, CAST(floor(c.turn / 1024) AS BIGINT) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM conversations c JOIN kept USING (conv_id)
GROUP BY c.conv_id, floor(c.turn / 1024)
"""
}
