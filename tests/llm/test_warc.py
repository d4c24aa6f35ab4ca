import gzip
import hashlib
import random

import duckdb

from palimpsest.llm import warc


def record(i, payload=None):
    payload = f"page {i} ".encode() * 40 if payload is None else payload
    return warc.record_bytes("response", f"urn:page:{i}", f"http://x/{i}", payload, len(payload), hashlib.sha1(payload).hexdigest())


def ids(found):
    return [r.fields["warc-record-id"] for kind, _, _, r in found if kind == "record"]


def gaps(found):
    return [(a, b) for kind, a, b, _ in found if kind == "gap"]


def test_whole_archives():
    for pack in (warc.member, bytes):
        data = b"".join(pack(record(i)) for i in range(5))
        found = list(warc.salvage(data))
        assert ids(found) == [f"<urn:page:{i}>" for i in range(5)] and not gaps(found)
    assert list(warc.salvage(b"")) == []


def test_members_end_in_zero():
    big = random.Random(1).randbytes(1 << 24)
    for payload in (b"", b"x", big):
        packed = warc.member(record(1, payload))
        assert packed[-1] == 0 and gzip.decompress(packed) == record(1, payload)


def test_damage_costs_only_what_it_touches():
    rng = random.Random(5)
    for pack in (warc.member, bytes):
        parts = [pack(record(i)) for i in range(9)]
        starts = [sum(map(len, parts[:i])) for i in range(10)]
        for _ in range(60):
            hit = rng.randrange(9)
            data = bytearray(b"".join(parts))
            at = starts[hit] + rng.randrange(len(parts[hit]) - 4)
            data[at] ^= 0x55
            found = list(warc.salvage(bytes(data)))
            assert {f"<urn:page:{i}>" for i in range(9) if i != hit} <= set(ids(found))
            spans = sorted((a, b) for _, a, b, _ in found)
            assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_cut_short_and_junk_between():
    parts = [warc.member(record(i)) for i in range(3)]
    data = b"junk" + parts[0] + b"\x1f\x8b\x08junk WARC/1.0\r\n" + parts[1] + parts[2][:-40]
    found = list(warc.salvage(data))
    assert ids(found) == ["<urn:page:0>", "<urn:page:1>"] and len(gaps(found)) == 3


def test_wrong_length_is_found_by_the_end_marker():
    plain = [record(i) for i in range(3)]
    bad = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert ids(list(warc.salvage(plain[0] + bad + plain[2]))) == ["<urn:page:0>", "<urn:page:2>"]


def test_rows(spark, tmp_path):
    long = "é<p>" * 400
    rows = [(1, "u", long, 0), (2, None, long, 0), (9, "a\r\nb c", long, 0), (9, "twice", long, 0), (None, "n", long, 0), (3, "u", None, 0), (4, "u", "short", 0), (5, "u", "short", 0), (6, "u", "", 0), (7, "u", "y" * 999, 0), (8, "u", "y" * 999, 0), (10, "u", "z" * 1000, 0), (11, "u", "z" * 1000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(pages), path)
    got = warc.read_archives(spark, path).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
    kinds = sorted((str(r.record_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in got)
    n = len(long.encode())
    want = [("1", 9, n), ("2", 9, n), ("9", None, n), ("9", None, n), ("none", 9, n), ("3", None, 0), ("4", None, 5), ("5", None, 5), ("6", None, 0), ("7", None, 999), ("8", None, 999), ("10", 11, 1000), ("11", None, 1000)]
    assert kinds == sorted((f"urn:page:{i}", "revisit" if to else "response", f"urn:page:{to}" if to else "None", size) for i, to, size in want)
    payloads = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert payloads["urn:page:9"] == long.encode() and payloads["urn:page:4"] == b"short"


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read_archives(spark, path).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in warc.op3_warc(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(con.execute(warc.ORACLE_SQL["op3_warc"]).fetchall(), key=key)


def test_headers_of_any_length(spark, tmp_path):
    urls = ["data:," + "x" * 100_000, "data:," + "a b\n" * 30_000, "data:," + "y" * (1 << 20) + "/WARC/1.1", "u"]
    records = [warc.record_bytes("response", f"urn:page:{i}", url, b"p", 1, hashlib.sha1(b"p").hexdigest()) for i, url in enumerate(urls)]
    for pack in (warc.member, bytes):
        found = list(warc.salvage(b"".join(map(pack, records))))
        assert ids(found) == [f"<urn:page:{i}>" for i in range(4)] and not gaps(found)
    cut = records[0][:90_000]
    assert ids(list(warc.salvage(cut + b"\n" + records[1] + records[3]))) == ["<urn:page:1>", "<urn:page:3>"]
    pages = spark.createDataFrame([(i, url, "p") for i, url in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in warc.op3_warc(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]


def test_members_of_several_records_keep_what_precedes_the_damage():
    records = [record(i, random.Random(i).randbytes(3000).hex().encode()) for i in range(3)]
    packed = gzip.compress(b"".join(records), mtime=0)
    after = warc.member(record(9))
    for damaged in (packed[:-2500], packed[:-2500] + after, packed[:-2000] + b"\xff" + packed[-1999:] + after, packed[:-3] + b"abc" + after):
        found = list(warc.salvage(damaged))
        want = {"<urn:page:0>", "<urn:page:1>"} | ({"<urn:page:9>"} if damaged.endswith(after) else set())
        assert want <= set(ids(found)) and gaps(found)
        assert all(r.block == warc.parse_record(records[int(r.fields["warc-record-id"][10])], 0)[0].block for k, _, _, r in found if k == "record" and r.fields["warc-record-id"] != "<urn:page:9>")
        spans = sorted({(a, b) for _, a, b, _ in found})
        assert spans[0][0] == 0 and spans[-1][1] == len(damaged) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    bad = records[1][:-10] + b"zz" + records[1][-8:]
    assert ids(list(warc.salvage(gzip.compress(records[0] + bad + records[2])))) == ["<urn:page:0>", "<urn:page:2>"]


def test_digests_in_base32_and_of_unknown_form(spark, tmp_path):
    import base64

    plain = record(1)
    sha = hashlib.sha1(warc.parse_record(plain, 0)[0].block)
    payload = plain.partition(b"WARC-Payload-Digest: sha1:")[2][:40]
    spelled = {
        "base32": plain.replace(sha.hexdigest().encode(), base64.b32encode(sha.digest())).replace(payload, base64.b32encode(bytes.fromhex(payload.decode()))),
        "upper": plain.replace(sha.hexdigest().encode(), sha.hexdigest().upper().encode()),
        "unknown": plain.replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: blake3:").replace(payload, b"???"),
    }
    for data in spelled.values():
        assert len(ids(list(warc.salvage(warc.member(data))))) == 1
    wrong = spelled["base32"].replace(b"page 1", b"page 2", 1)
    assert [r for k, _, _, r in warc.salvage(wrong) if k == "gap"] == ["block digest differs"]
    (tmp_path / "a.warc.gz").write_bytes(warc.member(spelled["base32"]) + warc.member(spelled["unknown"]))
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("start").collect()
    assert [r.kind for r in rows] == ["record", "record"] and [r.payload_digest for r in rows] == [payload.decode(), "???"]


def test_time_grows_with_the_members_and_not_their_square():
    import time

    took = []
    for n in (4000, 16000):
        data = warc.member(record(1)) * n
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 20_000)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 50)
    pages = spark.createDataFrame([(i, "u", random.Random(i).randbytes(1500).hex()) for i in range(120)] + [(999, "u", random.Random(3).randbytes(40_000).hex())], "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages.coalesce(1)), f"file://{tmp_path}/w")
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 8 and sorted(sizes)[-2] < 25_000
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted(r.record_id for r in got if r.kind == "record") == sorted(f"urn:page:{i}" for i in (*range(120), 999))
    assert {r.kind for r in got} == {"record", "padding"}
