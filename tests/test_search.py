"""Memory search: the control record, SQL, and descents that must fail."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search as op
from palimpsest.plans import search as plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The small store and two requests whose answers are not empty, as files."""
    folder = str(tmp_path_factory.mktemp("search"))
    store = plan.store(spark, SF)
    store.records.coalesce(1).write.parquet(f"{folder}/records")
    plan.requests(spark, SF).filter("request_id IN ('episodes-p0-loc', 'no-vector')").coalesce(1).write.parquet(f"{folder}/requests")
    records = spark.read.parquet(f"{folder}/records")
    return op.Store(records, store.policies, store.tombstones, store.control), spark.read.parquet(f"{folder}/requests")


def hits(written, control, after=None):
    store, few = written
    return op.search(op.Store(store.records, store.policies, store.tombstones, control, after), few, plan.CONFIG)


def test_control_decides(spark, written):
    steady = plan.control(spark)
    assert hits(written, steady).count() > 0
    for changed in ({"version": 0}, {"revoked": ["llm"]}, {"privacy_epoch": 2}):
        assert hits(written, plan.control(spark, **changed)).isEmpty(), changed
    assert hits(written, steady, plan.control(spark, version=4)).isEmpty()
    few = written[1]
    for changed in ({"state": "draining"}, {"owner_host": "beta"}, {"revoked": ["store"]}):
        assert op.gated(few, plan.control(spark, **changed), plan.CONFIG).isEmpty(), changed
    assert op.gated(few, steady.unionByName(steady), plan.CONFIG).isEmpty()


def test_a_revoked_embedding_leaves_the_exact_lane(spark, written):
    assert {r.lane for r in hits(written, plan.control(spark, revoked=["embedding"])).collect()} == {"exact"}


def test_sql_table_functions(spark, written):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("vector"))
    spark.udtf.register("memory_request", F.udtf(op.RequestRow, returnType=op.REQUEST_SCHEMA))
    spark.sql("SELECT * FROM memory_request('mine', '  THE re ', 'episodes', 'p0', 'local_only', 3)").createOrReplaceTempView("memory_requests")
    op.register_sql(spark, written[0], plan.CONFIG, lambda requests: requests.join(F.broadcast(vectors), F.lit(True)))
    got = spark.sql("SELECT position, id, lane FROM memory_search('mine') ORDER BY position").collect()
    assert [r.position for r in got] == [1, 2, 3] and all(r.id.startswith("ep-") for r in got)
    assert spark.sql("SELECT * FROM memory_search('another')").count() == 0


def test_lanes_are_cut_in_each_task_and_asked_once(spark, written):
    store, _ = written
    asked = op.gated(plan.requests(spark, SF).filter("request_id LIKE '%-p0-%'"), plan.control(spark), plan.CONFIG)
    assert asked.count() == 12
    # three reaches with one vector, and an exact lane of three modes for two of them
    assert op._probes(asked)[0].count() == 3 + 2 * 3
    lanes = op.lane_hits(store.records, asked, plan.CONFIG)
    assert "WindowGroupLimit" in lanes._jdf.queryExecution().optimizedPlan().toString()
    # registered and local identities have the same rows within the project
    by_kind = {kind: {(r.lane, r.id) for r in lanes.filter(f"q.request_id = 'all-p0-{kind}' AND reach = 'project'").collect()} for kind in ("reg", "loc")}
    assert by_kind["reg"] and by_kind["reg"] == by_kind["loc"]


def test_an_exact_lane_looks_at_every_record(spark, written):
    """Records that hold all terms are found behind any number that hold only one of them."""
    columns = written[0].records.schema
    common = dict.fromkeys(columns.names) | {"record_type": "episode", "owner_host": "alpha", "status": "active", "secret_scan": "passed", "privacy_epoch": 1, "project_id": "p0", "scope": "project", "created_at": 1}
    texts = [(f"ep-{n:05}", "the") for n in range(1100)] + [(f"ep-{n:05}", "over there") for n in range(1100, 1130)]
    records = spark.createDataFrame([tuple((common | {"id": i, "text": text})[c] for c in columns.names) for i, text in texts], columns)
    asked = op.gated(plan.requests(spark, SF).filter("request_id = 'no-vector'"), plan.control(spark), plan.CONFIG)
    got = op.lane_hits(records, asked, plan.CONFIG).select("lane", "id").collect()
    assert sorted((r.lane, r.id) for r in got) == [("exact", f"ep-{n:05}") for n in range(1100, 1120)]


#: Records below a summary, and whether a descent to them stands.
DESCENTS = {
    "two levels": ([("s1", "raptor_summary", ["s2", "e1"]), ("s2", "raptor_summary", ["e1", "e2"]), ("e1", "episode", None), ("e2", "episode", None)], {"e1", "e2"}),
    "missing": ([("s1", "raptor_summary", ["e1", "e9"]), ("e1", "episode", None)], None),
    "repeated": ([("s1", "raptor_summary", ["e1"]), ("e1", "episode", None), ("e1", "episode", None)], None),
    "cycle": ([("s1", "raptor_summary", ["s2"]), ("s2", "raptor_summary", ["s1"])], None),
    "no evidence": ([("s1", "raptor_summary", ["j1"]), ("j1", "job", None)], None),
    "too deep": ([(f"s{n}", "raptor_summary", [f"s{n + 1}"]) for n in range(1, 12)] + [("s12", "episode", None)], None),
    "deepest": ([(f"s{n}", "raptor_summary", [f"s{n + 1}"]) for n in range(1, 11)] + [("s11", "episode", None)], {"s11"}),
    "too wide": ([("s1", "raptor_summary", ["s2", "s3"]), ("s2", "raptor_summary", [f"e{n}" for n in range(1000)]), ("s3", "raptor_summary", [f"e{n}" for n in range(900, 1100)])] + [(f"e{n}", "episode", None) for n in range(1100)], None),
}


@pytest.mark.parametrize("name", DESCENTS)
def test_descent(spark, written, name):
    rows, want = DESCENTS[name]
    columns = written[0].records.schema
    blank = dict.fromkeys(columns.names)
    common = {"owner_host": "alpha", "status": "active", "secret_scan": "passed", "privacy_epoch": 1, "policy_epoch": 1, "policy_hash": "h1", "generation_id": "g1", "project_id": "p0", "covered_projects": ["p0"], "text": "x", "processing_policy_id": "pol0"}
    records = spark.createDataFrame([tuple((blank | common | {"id": i, "record_type": kind, "member_ids": members})[c] for c in columns.names) for i, kind, members in rows], columns)
    asked = op.gated(plan.requests(spark, SF).filter("request_id = 'raptor-p0-reg'"), plan.control(spark), plan.CONFIG)
    seeds = records.filter("id = 's1'").join(asked, F.lit(True)).withColumn("score", F.lit(0.5)).select("q", "c", "score", "processing_policy_id", "member_ids")
    got = op.descend(seeds, records, plan.CONFIG).select("id", "fails", "record_type", "ways").collect()
    if want is None:
        assert any(r.fails for r in got)
    else:
        assert {r.id for r in got} == want and not any(r.fails for r in got)
