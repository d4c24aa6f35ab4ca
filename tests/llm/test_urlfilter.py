"""URL filters against a plain walk over hosts, and against SQL."""

from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from palimpsest.llm import urlfilter

SCHEMA = "page_id long, url string, html string"
COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def a(*hosts):
    return "<html>" + " ".join(f'<a href="http://{h}/x">x</a>' for h in hosts)


PLANTED = [
    (1, "http://good.com/a", a("liked.org", "far.org")),
    (2, "https://GOOD.com/b?q=/en/", a("liked.org")),
    (3, "http://liked.org/x", a("far.org", "spam.net")),
    (4, "http://far.org", a()),
    (5, "http://spam.net/es/1", a("spam.net")),
    (6, "http://spam.net/de/2", a()),
    (7, "http://ring.org/1", a("spam.net", "other.net")),
    (8, "http://other.net/fr/#x", '<A HREF = //spam.net/q><a href="/local/http://good.com"><a href=\'https://Ring.org:80/x\'>'),
    (9, "http://ringring.org/?x", a("ring.org", "ring.org")),
    (10, "http://example.com/en/1", None),
    (11, "http://www.example.com/en/1", ""),
    (12, "http://sub.example.com/en/1", a("liked.org")),
    (13, "http://notexample.com/en/1", a()),
    (14, "http://a.net/en/1", a()),
    (15, None, a("spam.net")),
    (16, "", None),
    (17, "no scheme/com/", None),
    (18, "http://good.com", None),
    (19, "http://x.com:8080/en/", None),
    (20, "mailto://Ä.COM/#frag?x", None),
    (20, "http://two.com//y://z.net/es/", None),
    (None, "http://com/", None),
    (21, "http://both.net/fr/", a()),
    (22, "http://both.net/x", a()),
    (23, "http://good.com/z", a("both.net")),
    (24, "http://many.net/es/\nline", a("q.org")),
]


def brute(rows):
    def cut(url):
        url = url or ""
        if "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:n], rest[n:]
        m = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
        return "".join(c.lower() if c.isascii() else c for c in host), tail[:m]

    def fit(host, path):
        own = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(own, key=lambda r: len(r.text), default=None)

    known = [(i, *cut(url), fit(*cut(url)), html) for i, url, html in rows]
    pages, seeds = Counter(h for _, h, _, _, _ in known if h), defaultdict(Counter)
    for _, host, _, rule, _ in known:
        if host and rule:
            seeds[rule.verdict][host] += 1
    links = set()
    for _, host, _, _, html in known:
        for piece in (html or "").lower().split("href")[1:]:
            target = piece.lstrip(" =\"'").split(">")[0].split('"')[0].split("'")[0]
            for lead in ("http://", "https://", "//"):
                if target.startswith(lead):
                    to = target[len(lead) :].split("/")[0]
                    if host and to and to != host:
                        links.add((host, to))
                    break
    mass = {}
    for verdict, arcs in (("allow", links), ("block", {(d, s) for s, d in links})):
        out = Counter(s for s, _ in arcs)
        base = {h: int(Fraction(n * urlfilter.UNIT, pages[h])) // urlfilter.RESTART for h, n in seeds[verdict].items()}
        now = dict(base)
        for _ in range(urlfilter.STEPS):
            got = Counter()
            for s, d in arcs:
                got[d] += now.get(s, 0) // out[s]
            now = {h: got[h] - got[h] // urlfilter.RESTART + base.get(h, 0) for h in {*got, *base}}
        mass[verdict] = now
    return sorted(
        ((i, h, p, r and r.text, r.verdict if r else ("block" if mass["block"].get(h, 0) > mass["allow"].get(h, 0) else "allow")) for i, h, p, r, _ in known), key=str
    )


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_planted_links(spark):
    want = brute(PLANTED)
    assert ("block" in {v for *_, r, v in want if r is None}) and ("allow" in {v for *_, r, v in want if r is None})
    by_id = {r[0]: r for r in want}
    assert by_id[7][4] == "block" and by_id[9][4] == "block" and by_id[3][4] == "allow" and by_id[6][4] == "block"
    pages = spark.createDataFrame(PLANTED, SCHEMA).repartition(4)
    assert rows_of(urlfilter.judge(pages)) == want
    for extra in ("host", "path", "rule", "verdict", "fit", "kind", "mass", "bad_host", "src", "n"):
        pages = pages.withColumn(extra, F.lit("clash"))
    assert rows_of(urlfilter.judge(pages)) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PLANTED)
    got = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.ORACLE_SQL['op12_url_filter']})").fetchall()
    assert sorted(got, key=str) == want


def test_table_equals_plain_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = rows_of(urlfilter.op12_url_filter(spark, sf))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.ORACLE_SQL['op12_url_filter']})").fetchall(), key=str) == got


def test_empty_and_no_rules(spark):
    assert rows_of(urlfilter.judge(spark.createDataFrame([], SCHEMA))) == []
    one = spark.createDataFrame([(1, "http://a.com/x", a("b.com"))], SCHEMA)
    assert rows_of(urlfilter.judge(one, [])) == [(1, "a.com", "/x", None, "allow")]


def test_a_settled_graph_ends_early(spark):
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("trust", "a", urlfilter.UNIT)], "kind string, host string, seed long")
    got = {(r.kind, r.host): r.mass for r in urlfilter.propagated(links, seeds, steps=10**6).collect()}
    own = urlfilter.UNIT // 8
    assert got == {("trust", "a"): own, ("trust", "b"): own - own // 8}
