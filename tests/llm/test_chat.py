import duckdb

from palimpsest.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, s0 long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def conv(cid, *turns, start=0):
    return [(cid, i + start, r, t) for i, (r, t) in enumerate(turns)]


A, B, C = ("user", "hi"), ("assistant", "hello <|im_end|>"), ("user", "more")


def kept(spark, rows):
    return sorted((r.conv_id is None, r.conv_id or 0, r.part, r.n_turns) for r in chat.render_chat(frame(spark, rows)).collect())


def test_prefixes_collapse(spark):
    rows = conv(1, A) + conv(2, A, B) + conv(3, A, B, C) + conv(4, A, C) + conv(5, A, B, C) + conv(6, B) + conv(7, A, B, C, start=2000)
    assert kept(spark, rows) == [(False, 3, 0, 3), (False, 4, 0, 2), (False, 6, 0, 1)]


def test_nulls_ties_and_repeats(spark):
    rows = conv(1, A, (None, None)) + conv(2, A, ("user", None)) + conv(3, A, (None, "")) + conv(4, A, A) + [(5, 0, *A), (5, 0, *A)] + conv(None, A, B)
    assert kept(spark, rows) == [(False, 1, 0, 2), (False, 2, 0, 2), (False, 3, 0, 2), (False, 4, 0, 2), (True, 0, 0, 2)]
    assert [r.part for r in chat.render_chat(frame(spark, [(1, None, *A)])).collect()] == [None]


def test_text(spark):
    out = chat.render_chat(frame(spark, conv(1, A, B, (None, None)))).first()
    assert out.text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello < |im_end|><|im_end|>\n<|im_start|>unknown\n<|im_end|>\n"


def test_long_conversations_come_in_parts(spark):
    long = conv(1, *[("user", f"t{i % 7}") for i in range(3000)])
    rows = long + [(2, t, r, x) for _, t, r, x in long[:2500]] + [(3, t, r, x) for _, t, r, x in long[:2499]] + [(3, 2499, "user", "other")]
    assert kept(spark, rows) == [(False, 1, 0, 1024), (False, 1, 1, 1024), (False, 1, 2, 952), (False, 3, 0, 1024), (False, 3, 1, 1024), (False, 3, 2, 452)]


def test_empty(spark):
    assert kept(spark, []) == []


def test_native(spark):
    plan = chat.op8_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.execute(chat.ORACLE_SQL["op8_chat"]).fetchall())
    assert sorted(tuple(r) for r in chat.op8_chat(spark, sf).collect()) == want
