"""The versioned table: two writers, crashes, insert-only and compare-and-set."""

import threading
import time

import pytest

from palimpsest.streaming.ledger import Ledger, Stale

SCHEMA = "id string, content_hash string, version long"


@pytest.fixture
def table(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/table", SCHEMA)


def rows(table, *values):
    return table.spark.createDataFrame(list(values), SCHEMA).coalesce(1)


def current(table, version=None):
    return sorted(tuple(r)[:3] for r in table.read(version).collect())


def test_versions_and_time_travel(table):
    assert table.version() == 0 and current(table) == []
    table.commit(rows(table, ("a", "x", 1), ("b", "y", 1)), 0)
    table.commit(rows(table, ("a", "z", 2)), 1)
    assert current(table) == [("a", "z", 2), ("b", "y", 1)] and current(table, 1) == [("a", "x", 1), ("b", "y", 1)]
    with pytest.raises(Stale):
        table.commit(rows(table, ("a", "w", 2)), 1)
    assert table.version() == 2 and current(table) == [("a", "z", 2), ("b", "y", 1)]


def test_concurrent_writers_one_wins_each_version(table):
    """Each writer adds one to a counter three times; no addition is lost."""
    table.commit(rows(table, ("n", "0", 0)), 0)
    failed = []

    def add():
        try:
            for _ in range(3):
                table.update(lambda now: now.selectExpr("id", "content_hash", "version + 1 AS version"))
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=add) for _ in range(2)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and current(table) == [("n", "0", 6)] and table.version() == 7


def test_a_crash_between_files_and_commit_shows_nothing(table, monkeypatch):
    table.commit(rows(table, ("a", "x", 1)), 0)

    def crash(self, version, text):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_put_if_absent", crash)
        with pytest.raises(RuntimeError):
            table.commit(rows(table, ("a", "lost", 2)), 1)
    assert table.version() == 1 and current(table) == [("a", "x", 1)]
    assert table.sweep(0) == 0 and table.sweep(int(time.time() * 1000) + 60_000) == 1
    assert table.commit(rows(table, ("a", "y", 2)), 1) == 2 and current(table) == [("a", "y", 2)]


def test_insert_only(table):
    _, first = table.insert_only(rows(table, ("a", "x", 1), ("b", "y", 1), ("b", "y", 1), ("c", "p", 1), ("c", "q", 1)))
    assert sorted((r.id, r.outcome) for r in first.collect()) == [("a", "inserted"), ("b", "existing"), ("b", "inserted"), ("c", "collision"), ("c", "collision")]
    version, second = table.insert_only(rows(table, ("a", "x", 1), ("b", "other", 1)))
    assert version == 1 and sorted((r.id, r.outcome) for r in second.collect()) == [("a", "existing"), ("b", "collision")]
    assert current(table) == [("a", "x", 1), ("b", "y", 1)]


def test_compare_and_set(spark, table):
    schema = SCHEMA + ", expected_version long"
    change = lambda *values: spark.createDataFrame([(i, h, 0, e) for i, h, e in values], schema)
    _, out = table.compare_and_set(change(("a", "x", 0), ("b", "y", 3)))
    assert sorted((r.id, r.outcome) for r in out.collect()) == [("a", "applied"), ("b", "stale")]
    _, out = table.compare_and_set(change(("a", "z", 1), ("c", "1", 0), ("c", "2", 0)))
    assert sorted((r.id, r.outcome) for r in out.collect()) == [("a", "applied"), ("c", "stale"), ("c", "stale")]
    version, out = table.compare_and_set(change(("a", "w", 1)))
    assert version == 2 and [r.outcome for r in out.collect()] == ["stale"] and current(table) == [("a", "z", 2)]
