"""URL filters: rules by host and path, and for the rest what links say of a host.

Trust flows along links from hosts whose pages the rules allow, as a personalised
PageRank; distrust flows against them from hosts whose pages they block, so a host that
links to blocked ones gets some. Masses are integers, so every sum and every comparison
is exact whatever the order of addition. Nothing but the rules is held by the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import discard, materialize

#: Mass of a seed host all of whose pages the rules name; up to 2**32 such hosts fit 64 bits.
UNIT = 1 << 30
#: One part in RESTART of a host's mass is its own seed; the rest comes along links.
RESTART = 8
#: Steps of propagation at most (7/8 to the 24th is 4 %), and how many are made between writes.
STEPS, STEPS_A_WRITE = 24, 4
#: Rules are constants of the plan, so their number is bounded.
MAX_RULES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of a url: after the first ://.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Targets of links that name a host.
LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?((?:https?:)?//[^"'> \t\r\n]+)"""
LINK_HOST = r"(?s)^[^/]*//([^/?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of op12's contract, fixed values.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A to Z lower-cased, and path; both empty where there is no ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules
    of equal length the first of the list wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are held in a plan")
    ordered = sorted(rules, key=lambda r: -len(r.text))
    kind = "struct<text:string,verdict:string,host:string,path:string>"
    if not ordered:
        return F.lit(None).cast(kind)
    known = F.array(*[F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path")) for r in ordered])
    return F.get(F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])), F.lit(0))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of hosts whose pages link to another host's; takes host and html."""
    targets = F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1))))
    links = pages.select(F.col("host").alias("src"), targets.alias("link"))
    found = links.select("src", F.translate(F.regexp_extract("link", LINK_HOST, 1), UPPER, LOWER).alias("dst"))
    return found.filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def propagated(links: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """(kind, host, mass) of trust along links and of distrust against them.

    ``links`` has distinct (src, dst), ``seeds`` (kind, host, seed) with kind 'trust' or
    'distrust'. Each step sends a host's mass in equal parts over its links; mass at a
    host without links ends there. Both kinds go in one frame, a step being one equi-join
    and one sum with map-side combine; every few steps are written to the shared folder.
    Ends early where nothing changes any more.
    """
    arcs = links.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degrees = arcs.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    arcs = materialize(arcs.join(degrees, ["kind", "src"]), "arcs")
    base = materialize(seeds.select("kind", "host", F.expr(f"seed div {RESTART}").alias("mass")).filter("mass > 0"), "seeds")
    now, done = base, 0
    if arcs.isEmpty():
        return now
    while done < steps:
        many = min(STEPS_A_WRITE, steps - done)
        further = now
        for _ in range(many):
            flow = further.withColumnRenamed("host", "src").join(arcs, ["kind", "src"]).select("kind", F.col("dst").alias("host"), F.expr("mass div degree").alias("part"), F.lit(0).cast("long").alias("own"))
            held = base.select("kind", "host", F.lit(0).cast("long").alias("part"), F.col("mass").alias("own"))
            sums = flow.unionByName(held).groupBy("kind", "host").agg(F.sum("part").alias("part"), F.sum("own").alias("own"))
            further = sums.select("kind", "host", F.expr(f"part - part div {RESTART} + own").alias("mass")).filter("mass > 0")
        new = materialize(further, "masses")
        same = new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty()
        if done:
            discard(now)
        now, done = new, done + many
        if same:
            break
    return now


def judge(pages: DataFrame, rules: list[Rule] | None = None, steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Takes page_id, url and html; other columns are ignored. The longest rule that fits a
    url decides. Where none does, the page is blocked if its host's distrust exceeds its
    trust, and allowed otherwise: so is a host that neither reaches, and a url without
    host. A host is a seed in proportion to the share of its pages that rules allow or
    block. Links are absolute http(s) or protocol-relative targets of href; a null html
    has none, repeated links and links to the own host count for nothing. Null urls have
    empty host and path; null and repeated ids are rows of their own; an empty table
    gives an empty one.
    """
    rules = RULES if rules is None else rules
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("fit", longest_rule(rules, F.col("host"), F.col("path")))
    known = materialize(rows.select("page_id", "host", "path", F.col("fit.text").alias("rule"), F.col("fit.verdict").alias("verdict")), "ruled")
    shares = known.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust"))
    seeds = shares.select("host", "n", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, named)")).filter("named > 0").select("kind", "host", F.expr(f"CAST(CAST(named AS decimal(38,0)) * {UNIT} div n AS bigint)").alias("seed"))
    masses = propagated(host_links(rows.select("host", "html")), seeds, steps)
    bad = masses.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(-F.col("mass"))).alias("more")).filter("more > 0").select(F.col("host").alias("bad_host"))
    ruled, rest = known.filter("rule IS NOT NULL"), known.filter("rule IS NULL")
    judged = rest.join(bad, rest["host"] == bad["bad_host"], "left").withColumn("verdict", F.when(F.col("bad_host").isNull(), "allow").otherwise("block")).drop("bad_host")
    return ruled.unionByName(judged)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages``, by the rules of the contract."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    """The same in SQL, each step a table of its own."""
    ordered = sorted(RULES, key=lambda r: -len(r.text))
    case = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in ordered)
    verdicts = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in ordered)
    link = LINK.replace("'", "''")
    steps = "".join(
        f""",
t{k} AS MATERIALIZED (
  SELECT kind, host, sum(part)::BIGINT - sum(part)::BIGINT // {RESTART} + sum(own)::BIGINT AS mass FROM (
    SELECT a.kind, dst AS host, mass // degree AS part, 0 AS own FROM t{k - 1} t JOIN arcs a ON t.kind = a.kind AND t.host = a.src
    UNION ALL SELECT kind, host, 0, mass FROM t0) GROUP BY kind, host)"""
        for k in range(1, STEPS + 1)
    )
    return f"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{URL}', 2) AS path, html FROM pages),
known AS MATERIALIZED (SELECT page_id, host, path, html, CASE {case} END AS rule FROM cut),
ruled AS (SELECT *, CASE rule {verdicts} END AS verdict FROM known),
shares AS (SELECT host, count(*) AS n, count(*) FILTER (verdict = 'allow') AS y, count(*) FILTER (verdict = 'block') AS b FROM ruled WHERE host <> '' GROUP BY host),
t0 AS MATERIALIZED (
  SELECT kind, host, (named * {UNIT} // n) // {RESTART} AS mass
  FROM (SELECT 'trust' AS kind, host, y AS named, n FROM shares UNION ALL SELECT 'distrust', host, b, n FROM shares) WHERE named > 0),
links AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(regexp_extract(link, '{LINK_HOST}', 1), '{UPPER}', '{LOWER}') AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM known))
  WHERE src <> '' AND dst <> '' AND src <> dst),
both_ways AS (SELECT 'trust' AS kind, src, dst FROM links UNION ALL SELECT 'distrust', dst, src FROM links),
arcs AS MATERIALIZED (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM both_ways){steps},
bad AS (SELECT host FROM t{STEPS} GROUP BY host HAVING sum(CASE kind WHEN 'distrust' THEN mass ELSE -mass END) > 0)
SELECT page_id, r.host, path, rule, coalesce(verdict, CASE WHEN b.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r LEFT JOIN bad b ON r.host = b.host"""


QUERIES = {"op12_url_filter": op12_url_filter}
ORACLE_SQL = {"op12_url_filter": _oracle()}
