"""A table kept by a stream against upserts of all that arrived."""

import pytest

from quillon.streaming import commits, tables

SCHEMA = "k long, v string, at int"


def test_versions_follow_the_batches(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    batches = [[(1, "a", 1), (2, "b", 1), (1, "c", 2)], [(2, None, 3), (3, "d", 3)], []]
    want: dict = {}
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        tables.kept(stream, folder, "k", "at", checkpoint).awaitTermination()
        for k, v, at in rows:
            want[k] = (v, at)
        got = tables.current(spark, folder, stream.schema)
        assert {r.k: (r.v, r["at"]) for r in got.collect()} == want
    n = len(tables.versions(spark, folder))
    tables.kept(stream, folder, "k", "at", checkpoint).awaitTermination()
    assert len(tables.versions(spark, folder)) == n >= 2
    assert tables.current(spark, str(tmp_path / "none"), stream.schema).count() == 0


def test_several_tables_are_committed_at_once(spark, tmp_path, monkeypatch):
    t = commits.Tables(spark, str(tmp_path / "store"))
    assert t.commits() == [] and t.manifest()["commit"] is None and t.vacuum() == 0
    with pytest.raises(KeyError):
        t.read("index")
    index = lambda *rows: spark.createDataFrame(rows, "path string, scan int")
    memory = lambda *rows: spark.createDataFrame(rows, "k long, v string, at int")
    assert t.commit(1, {"index": index(("a", 1))}, {"memory": (memory((1, "x", 1), (None, "n", 1)), "k", "at")})
    before = t.manifest()
    assert t.commit(2, {"index": index(("a", 2), ("b", 2))}, {"memory": (memory((1, "y", 2), (2, None, 2), (2, "z", 1)), "k", "at")})
    assert not t.commit(2, {"index": index(("never", 0))})
    rows = lambda name, m=None: sorted(map(str, map(tuple, t.read(name, manifest=m).collect())))
    assert rows("index") == ["('a', 2)", "('b', 2)"] and rows("memory") == ["(1, 'y', 2)", "(2, None, 2)", "(None, 'n', 1)"]
    # a reader of the first commit still sees both tables of it
    assert rows("index", before) == ["('a', 1)"] and rows("memory", before) == ["(1, 'x', 1)", "(None, 'n', 1)"]
    # a commit that fails before its manifest is in place is seen by no one, and what it wrote goes
    monkeypatch.setattr(commits.Tables, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.commit(3, {"index": index(("c", 3))}, {"memory": (memory((9, "q", 3)), "k", "at")})
    monkeypatch.undo()
    assert t.commits() == [1, 2] and rows("index") == ["('a', 2)", "('b', 2)"]
    # only the touched buckets are written again
    parts = {b: p for b, p in t.manifest()["tables"]["memory"]["parts"].items()}
    t.commit(3, upserts={"memory": (memory((2, "w", 3)), "k", "at")})
    now = t.manifest()["tables"]["memory"]["parts"]
    assert len([b for b in now if now[b] != parts.get(b)]) == 1 and t.manifest()["tables"]["index"] == t.manifest(2)["tables"]["index"]
    assert t.commit(4) and t.commit(5, upserts={"memory": (memory(), "k", "at")})
    assert rows("memory") == ["(1, 'y', 2)", "(2, 'w', 3)", "(None, 'n', 1)"]
    assert t.vacuum() >= 1 and t.commits() == [5] and rows("memory") == ["(1, 'y', 2)", "(2, 'w', 3)", "(None, 'n', 1)"] and rows("index") == ["('a', 2)", "('b', 2)"]
    with pytest.raises(Exception, match="exists|Exists"):  # another writer has put the manifest of that number there
        t._publish(5, {"commit": 5, "tables": {}})
    with pytest.raises(ValueError, match="kept by"):
        t.commit(6, upserts={"memory": (memory((1, "x", 1)), "v", "at")})
