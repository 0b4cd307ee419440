"""Keyed tables over restarts, crashes, rival writers and clean-ups."""

import os
import subprocess
import sys
import textwrap

import pytest

from orrery.sources import keyed
from orrery.streaming import jobs as J

SCHEMA = "uri string, seq long, hash_value string"


def table(spark, path, **options):
    return keyed.KeyedTable(spark, SCHEMA, "uri", "seq", path=f"file://{path}/t", **{"parts": 4, **options})


def rows(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "uri string, seq long, hash_value string, event string")


def test_a_new_object_goes_on(spark, tmp_path):
    table(spark, tmp_path).merge(batch(spark, ("a", 1, "x", "create"), ("b", 2, "y", "create"), (None, 3, "z", "create")))
    t = table(spark, tmp_path, parts=9)  # the number of parts is the table's own
    assert rows(t) == [("a", 1, "x"), ("b", 2, "y")] and t.snapshot().parts == 4
    t.merge(batch(spark, ("a", 5, None, "delete"), ("c", 6, "c", "create")))
    assert rows(table(spark, tmp_path)) == [("b", 2, "y"), ("c", 6, "c")]
    table(spark, tmp_path).merge(batch(spark, ("a", 4, "late", "create")))  # older than the delete
    assert rows(table(spark, tmp_path)) == [("b", 2, "y"), ("c", 6, "c")]
    assert rows(table(spark, tmp_path), version=1) == [("a", 1, "x"), ("b", 2, "y")]


def test_batches_come_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.merge(batch(spark, ("a", 1, "x", "create")), 0, "w")
    assert not t.merge(batch(spark, ("a", 9, "again", "create")), 0, "w")
    assert t.merge(batch(spark, ("b", 1, "other writer", "create")), 0, "v")
    assert t.merge(batch(spark), 1, "w") and not table(spark, tmp_path).merge(batch(spark, ("a", 9, "q", "create")), 1, "w")
    assert not t.merge(batch(spark))
    assert rows(t) == [("a", 1, "x"), ("b", 1, "other writer")] and t.snapshot().batches == {"w": 1, "v": 0}


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(batch(spark, ("a", 1, "x", "create")), 0)
    with monkeypatch.context() as m:
        m.setattr(keyed.Files, "publish", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            t.merge(batch(spark, ("a", 2, "y", "create"), ("b", 2, "y", "create")), 1)
    assert rows(table(spark, tmp_path)) == [("a", 1, "x")]
    data = lambda: set(os.listdir(tmp_path / "t/data"))
    assert len(data()) == 2  # what the crash left
    assert t.vacuum() == 0 and len(data()) == 2  # too young to be taken
    again = table(spark, tmp_path)
    assert again.merge(batch(spark, ("a", 2, "y", "create"), ("b", 2, "y", "create")), 1)
    assert rows(again) == [("a", 2, "y"), ("b", 2, "y")]
    assert again.vacuum(older_ms=0) >= 1 and again.versions() == [2]
    assert rows(table(spark, tmp_path)) == [("a", 2, "y"), ("b", 2, "y")]


def test_of_two_writers_one_merges_again(spark, tmp_path, monkeypatch):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    old, first = keyed.KeyedTable._publish, []

    def late(self, new):
        if not first:
            first.append(1)
            other.merge(batch(spark, ("b", 1, "theirs", "create"), ("a", 7, "newer", "create")))
        old(self, new)

    monkeypatch.setattr(keyed.KeyedTable, "_publish", late)
    assert t.merge(batch(spark, ("a", 2, "mine", "create"), ("c", 3, "mine", "create")))
    assert rows(t) == [("a", 7, "newer"), ("b", 1, "theirs"), ("c", 3, "mine")] and t.versions() == [1, 2]
    with pytest.raises(keyed.Conflict):
        t._files.publish(f"log/{1:020d}.json", "{}")


def test_compaction_and_clean_up(spark, tmp_path):
    t = table(spark, tmp_path)
    for n in range(4):
        t.merge(batch(spark, *((f"u{i}", 10 * n + i, f"h{n}", "delete" if (i + n) % 5 == 0 else "create") for i in range(30))), n)
    want = rows(t)
    t.compact(parts=2)
    assert rows(t) == want and len(t.snapshot().folders) <= 2
    assert t._rows(t.snapshot()).filter("_deleted").count() == 6
    t.compact(forget=10**6)
    assert t._rows(t.snapshot()).filter("_deleted").count() == 0 and rows(t) == want
    t.vacuum(keep=2, older_ms=0)
    assert t.versions() == [5, 6] and rows(t, 5) == rows(t) == want
    assert len(os.listdir(tmp_path / "t/data")) == 2
    assert not t.merge(batch(spark, ("u1", 999, "x", "create")), 3)  # batches are remembered


def test_keys_of_two_columns(spark, tmp_path):
    t = keyed.KeyedTable(spark, "plugin string, uri string, seq long", ["plugin", "uri"], "seq", path=f"file://{tmp_path}/t")
    change = lambda *r: spark.createDataFrame(list(r), "plugin string, uri string, seq long, event string")
    t.merge(change(("p", "a", 1, "c"), ("q", "a", 1, "c"), (None, "a", 5, "c")))
    t.merge(change(("p", "a", 2, "delete"), ("q", "b", 3, "c")))
    assert rows(t) == [("q", "a", 1), ("q", "b", 3)]


def test_a_consumer_in_two_processes(spark, tmp_path):
    """The second process finds the first one's rows and goes on from its checkpoint; a replayed batch changes nothing."""
    source = tmp_path / "in"
    batch(spark, ("a", 1, "x", "create"), ("b", 1, "x", "create"), ("c", 1, "x", "create")).coalesce(1).write.json(str(source / "1"))
    code = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        from orrery.streaming import jobs as J
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        t = J.KeyedTable(spark, "{SCHEMA}", "uri", "seq", parts=3, path="file://{tmp_path}/t")
        stream = spark.readStream.schema("uri string, seq long, hash_value string, event string").json("{source}/*")
        J.consume(stream, t, "file://{tmp_path}/checkpoint")
    """)
    run = lambda: subprocess.run([sys.executable, "-c", code], check=True, timeout=300, env=os.environ)
    run()
    first = table(spark, tmp_path)
    assert rows(first) == [(u, 1, "x") for u in "abc"]
    batch(spark, ("a", 2, "y", "create"), ("b", 3, None, "delete")).coalesce(1).write.json(str(source / "2"))
    run()
    assert rows(table(spark, tmp_path)) == [("a", 2, "y"), ("c", 1, "x")] and first.versions() == [1, 2]
    os.remove(tmp_path / "checkpoint/commits/1")  # as if it had died after publishing, before the checkpoint knew
    for f in (tmp_path / "checkpoint/commits").glob(".1.*"):
        os.remove(f)
    run()
    assert rows(table(spark, tmp_path)) == [("a", 2, "y"), ("c", 1, "x")] and first.versions() == [1, 2]
