"""Content reuse as keyed state: several batches and a restart against one look at the log, with results that end by the log's own clock."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from orrery.plans import indexing
from orrery.streaming import jobs as J

START = datetime.datetime(2024, 1, 1)
SCHEMA = "kind string, plugin string, uri string, hash_value string, seq long, ts timestamp"


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in indexing._STATE}
    for k, v in indexing._STATE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def log(n, seed=0):
    rng = random.Random(seed)
    return [(rng.choice(["job", "job", "result", "gone"]), rng.choice("pq"), f"u{rng.randint(0, 8)}", rng.choice(["a", "b", "c", None]), i, START + datetime.timedelta(minutes=7 * i)) for i in range(n)]


def wanted(rows, ttl_ms):
    kept, out = {}, []
    for kind, plugin, uri, h, seq, ts in rows:
        if kind == "result" and h is not None:
            kept[plugin, uri, h] = ts
        elif kind == "gone":
            kept = {k: t for k, t in kept.items() if k[1:] != (uri, h)}
        elif kind == "job":
            src = min((u for (p, u, c), t in kept.items() if p == plugin and c == h and u != uri and (ts - t).total_seconds() * 1000 < ttl_ms), default=None)
            out.append((seq, "run" if src is None else "copy", src))
    return sorted(out)


def run(spark, rows, path, ttl_ms, cut, out):
    source = path / "in"
    source.mkdir(exist_ok=True)
    for k, some in enumerate(cut):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(str(path / f"part{rows}-{k}"))
        (file,) = (path / f"part{rows}-{k}").glob("*.parquet")
        file.rename(source / f"{rows}-{k}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    J.run_available(J.reuse_stream(stream, ttl_ms, "0 seconds"), each=lambda df, n: out.extend(tuple(r) for r in df.collect()), checkpoint=str(path / "checkpoint"))


def test_batches_and_a_restart(spark, rocks, tmp_path):
    rows, ttl = log(400), 9 * 3600 * 1000
    out = []
    parts = [rows[k * 80 : (k + 1) * 80] for k in range(5)]
    run(spark, 0, tmp_path, ttl, parts[:2], out)
    run(spark, 1, tmp_path, ttl, parts[2:], out)
    jobs = sorted((seq, action, src) for _, _, seq, action, src, _ in out if action != "evict")
    assert jobs == wanted(rows, ttl)
    assert jobs != wanted(rows, 10**12)  # some results were over
    gone = [(p, u, h) for p, u, _, action, _, h in out if action == "evict"]
    told = {(p, u, h) for kind, p, u, h, _, _ in rows if kind == "result"}
    assert gone and set(gone) <= told


def test_results_end_when_the_clock_says(spark, rocks, tmp_path):
    """A result is used until just before its end, not at it, and is taken out once the watermark has passed."""
    hour = lambda h, ms=0: START + datetime.timedelta(hours=h, milliseconds=ms)
    ttl = 3600 * 1000
    batches = [
        [("result", "p", "u1", "a", 0, hour(0)), ("job", "p", "u2", "a", 1, hour(1, -1)), ("job", "p", "u2", "a", 2, hour(1))],
        [("result", "p", "u1", "a", 3, hour(2)), ("job", "p", "u1", "a", 4, hour(2)), ("job", "q", "u3", "a", 5, hour(2)), ("job", "p", "u3", "a", 6, hour(2, 5))],
        [("job", "p", "u9", "z", 7, hour(5))],
        [("job", "p", "u9", "z", 8, hour(6))],
    ]
    out = []
    run(spark, 0, tmp_path, ttl, batches, out)
    assert sorted(r[2:5] for r in out if r[3] != "evict") == [(1, "copy", "u1"), (2, "run", None), (4, "run", None), (5, "run", None), (6, "copy", "u1"), (7, "run", None), (8, "run", None)]
    assert [r[:2] for r in out if r[3] == "evict"] == [("p", "u1")]


def test_moves_are_what_goes(spark, rocks, tmp_path):
    rows = [("a", 1, "create", "x"), ("a", 2, "create", "x"), ("a", 3, "create", "y"), ("a", 4, "delete", None), ("a", 5, "delete", None), ("a", 6, "create", "z"), ("b", 1, "create", None), ("b", 2, "create", "q"), ("b", 3, "create", None)]
    spark.createDataFrame(rows, "uri string, seq long, event string, hash_value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uri string, seq long, event string, hash_value string").parquet(str(tmp_path / "in"))
    out = []
    J.run_available(J.moves(stream), each=lambda df, n: out.extend(tuple(r) for r in df.collect()), checkpoint=str(tmp_path / "c"))
    assert sorted(out) == [("a", 3, "x"), ("a", 4, "y"), ("b", 3, "q")]


def test_all_that_is_over_goes_at_once(spark, rocks, tmp_path):
    """One run of the timer takes out every result whose end the watermark has passed, and an older result doesn't shorten a newer one of its path."""
    hour = lambda h: START + datetime.timedelta(hours=h)
    first = [("result", "p", f"u{k}", "a", k, hour(k / 10)) for k in range(9)] + [("result", "p", "u0", "a", 9, hour(3)), ("result", "p", "u0", "a", 10, hour(1))]
    out = []
    run(spark, 0, tmp_path, 3600 * 1000, [first, [("job", "p", "u9", "a", 11, hour(3.5)), ("job", "q", "u9", "b", 12, hour(3.9))]], out)
    assert sorted(r[2:5] for r in out if r[3] != "evict") == [(11, "copy", "u0"), (12, "run", None)]
    assert sorted(r[1] for r in out if r[3] == "evict") == [f"u{k}" for k in range(1, 9)]


def test_least_source_in_time():
    """Against a look at all paths, with times that come and go."""
    rng = random.Random(3)
    times = J._Times({f"u{k:02}": k for k in range(5)}, {f"u{k:02}" for k in range(37)})
    known = times.times()
    for n in range(2000):
        path, time = f"u{rng.randint(0, 36):02}", rng.choice([times.NEVER, n])
        times.put(path, time)
        known[path] = time
        after, but = n - rng.randint(0, 20), f"u{rng.randint(0, 40):02}"
        assert times.least(after, but) == min((p for p, t in known.items() if t > after and p != but), default=None)
    assert times.times() == {p: t for p, t in known.items() if t != times.NEVER}
    assert J._Times({}, set()).least(0, "u") is None
