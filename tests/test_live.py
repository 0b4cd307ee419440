"""Live progress of running consumers, and folders as streams."""

import json
import os
import time

from pyspark.sql import functions as F

from orrery.sources import listing as L
from orrery.sources.ingest import rescan_as_changes
from orrery.streaming import jobs as J
from orrery.streaming import progress as P


def test_lag_of_two_running_consumers(spark, tmp_path):
    """One goes on while the other stops; what each lags behind the log, and after a restart."""
    source = tmp_path / "in"
    source.mkdir()
    n = 0

    def more(rows):
        nonlocal n
        (source / f".{n}").write_text("".join(json.dumps({"seq": i}) + "\n" for i in range(n, n + rows)))
        os.rename(source / f".{n}", source / f"{n}.json")
        n += rows

    log = P.ProgressLog(spark, f"file://{tmp_path}/progress")
    spark.streams.addListener(log)

    def start(name, done=None):
        stream = P.tracked(spark.readStream.schema("seq long").json(str(source)), done=done)
        return stream.writeStream.queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(processingTime="0 seconds").foreachBatch(lambda df, _: df.write.format("noop").mode("append").save()).start()

    def lags():
        return {r.consumer: (r.read, r.processed, r.lag, r.behind) for r in P.live_progress(spark.read.schema("seq long").json(str(source)), log.rows()).collect()}

    def wait(want):
        for _ in range(300):
            if lags() == want:
                return
            time.sleep(0.2)
        assert lags() == want

    try:
        assert lags() == {}
        more(10)
        fast, slow = start("fast"), start("slow", F.col("seq") % 2 == 0)
        wait({"fast": (10, 10, 0, 0), "slow": (10, 5, 0, 0)})
        slow.stop()
        more(7)
        wait({"fast": (17, 17, 0, 0), "slow": (10, 5, 7, 7)})
        fast.stop()
        more(3)
        assert lags() == {"fast": (17, 17, 3, 3), "slow": (10, 5, 10, 10)}
        again = start("slow", F.col("seq") % 2 == 0)
        wait({"fast": (17, 17, 3, 3), "slow": (20, 10, 0, 0)})
        again.stop()
        assert log.rows().filter("consumer = 'slow'").select("batch").distinct().count() == log.rows().filter("consumer = 'slow'").count() >= 2
        assert "latest" in json.loads(log.rows().first().offsets)[0]
    finally:
        spark.streams.removeListener(log)
        for q in spark.streams.active:
            q.stop()


def test_a_folder_as_a_stream(spark, tmp_path):
    """Creates, updates and deletes of each listing, over restarts, equal to the batch form; hidden and ignored files never come."""
    root, state = tmp_path / "root", f"file://{tmp_path}/state"
    (root / "a/b").mkdir(parents=True)
    got = []

    def put(name, text, at):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    def snapshot():
        return spark.createDataFrame([(f"file://{root}{u.removeprefix(str(root))}", f"file://{root}{u.removeprefix(str(root))}/{os.stat(u).st_mtime_ns}") for d, _, fs in os.walk(root) for f in fs if not f.startswith(".") and not (u := f"{d}/{f}").endswith(".tmp")], "uri string, hash_value string")

    def run():
        stream = L.listing_stream(spark, f"file://{root}", state, parts=3, ignore=[r"\.tmp$"])
        J.run_available(stream, each=lambda df, n: got.append(sorted(tuple(r)[:3] for r in df.collect())), checkpoint=f"{tmp_path}/c")

    none = spark.createDataFrame([], "uri string, hash_value string")
    for i in range(20):
        put(f"a/b/f{i}.usd", "x" * i, 1000 + i)
    put("a/.hidden", "x", 5)
    put("a/x.tmp", "x", 5)
    want = lambda old, new: sorted(tuple(r) for r in rescan_as_changes(old, new).select("uri", "event", "hash_value").collect())
    one = snapshot()
    run()
    assert [g for g in got if g] == [want(none, one)] and len(want(none, one)) == 20
    got.clear()
    run()  # nothing changed
    assert not any(got)
    put("a/b/f1.usd", "new", 9000)
    put("c/new.png", "p", 9000)
    os.remove(root / "a/b/f2.usd")
    two = snapshot()
    run()
    assert [g for g in got if g] == [want(one, two)] and {e for _, e, _ in want(one, two)} == {"create", "update", "delete"}
    last = max((tmp_path / "c/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    os.remove(last)  # as if it had died before the batch was done
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    got.clear()
    run()
    assert [g for g in got if g] == [want(one, two)]
    reader = L.ListingReader({"path": f"file://{root}", "state": state, "parts": "3", "ignore": r"\.tmp$"})
    assert len(reader.partitions({"snapshot": 1}, {"snapshot": 2})) == 3 and len(reader._snapshots()) <= 2


def test_a_folder_that_is_empty_or_not_there(spark, tmp_path):
    reader = L.ListingReader({"path": f"file://{tmp_path}/none", "state": f"file://{tmp_path}/state", "parts": "2"})
    end = reader.latestOffset()
    assert end == {"snapshot": 1} == reader.latestOffset()
    assert [r for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)] == []
