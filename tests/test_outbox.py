"""The outbox: restart, a killed writer, malformed files, jobs written twice."""

import pytest

from palimpsest.streaming import outbox

SCHEMA = "producer_id string, job_id string, payload string"


@pytest.fixture
def places(tmp_path):
    return f"file://{tmp_path}/outbox", f"file://{tmp_path}/out", tmp_path


def told(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_jobs_are_read_once_across_restarts(spark, places):
    path, folder, _ = places
    outbox.write_jobs(spark.createDataFrame([("a", "j1", "x"), ("a", "j2", "y"), ("b", "j3", "z")], SCHEMA), path)
    jobs, bad = outbox.drain(spark, path, folder)
    assert told(jobs) == [("a", 0, "j1", "x"), ("a", 1, "j2", "y"), ("b", 0, "j3", "z")] and told(bad) == []
    # j2 again is no new job
    outbox.write_jobs(spark.createDataFrame([("a", "j2", "y"), ("a", "j4", "w"), ("c", "j5", "v")], SCHEMA), path)
    jobs, _ = outbox.drain(spark, path, folder)
    assert told(jobs) == [("a", 0, "j1", "x"), ("a", 1, "j2", "y"), ("a", 2, "j4", "w"), ("b", 0, "j3", "z"), ("c", 0, "j5", "v")]
    assert told(spark.read.format("memory_outbox").option("path", path).load().drop("error")) == told(jobs)
    assert told(outbox.drain(spark, path, folder)[0]) == told(jobs)


def test_a_killed_writer_leaves_nothing_to_read(spark, places, monkeypatch):
    path, folder, tmp = places
    writer = outbox._Writer(path, spark.createDataFrame([], SCHEMA).schema)
    drafts = writer.write(iter([("a", "j1", "x"), ("a", "j2", "y")]))
    assert len(list((tmp / "outbox" / ".drafts").iterdir())) == 2
    assert spark.createDataFrame([("z", "j0", "o")], SCHEMA).count() == 1
    outbox.write_jobs(spark.createDataFrame([("z", "j0", "o")], SCHEMA), path)
    assert told(outbox.drain(spark, path, folder)[0]) == [("z", 0, "j0", "o")]
    writer.commit([drafts, None])
    assert [r[2] for r in told(outbox.drain(spark, path, folder)[0])] == ["j1", "j2", "j0"]


def test_malformed_files_are_told_once(spark, places):
    path, folder, tmp = places
    outbox.write_jobs(spark.createDataFrame([("a", "j1", "x"), ("a", "j2", "y")], SCHEMA), path)
    first = sorted((tmp / "outbox" / "a").iterdir())[0]
    first.write_text(first.read_text().replace('"x"', '"tampered"'))
    (tmp / "outbox" / "a" / "000000000007-x.json").write_text("{")
    (tmp / "outbox" / "a" / "000000000008-y.json").write_bytes(b"\xff\xfe")
    for _ in range(2):
        jobs, bad = outbox.drain(spark, path, folder)
        assert told(jobs) == [("a", 1, "j2", "y")]
        assert [(r.producer_id, r.sequence) for r in sorted(bad.collect())] == [("a", 0), ("a", 7), ("a", 8)]


def test_capacity(spark, places, monkeypatch):
    path, _, tmp = places
    monkeypatch.setattr(outbox, "CAPACITY", 1)
    writer = outbox._Writer(path, spark.createDataFrame([], SCHEMA).schema)
    drafts = writer.write(iter([("a", "j1", "x"), ("a", "j2", "y")]))
    with pytest.raises(ValueError):
        writer.commit([drafts])
    assert list((tmp / "outbox" / ".drafts").iterdir()) == []
