"""Incremental indexing as streaming queries: routing, change detection, fan-out, retries, history, write-back.

Every job is a function of a streaming (or batch) DataFrame. run_available() reads what there is, with a
checkpoint in the shared folder, so a job that is started again goes on where it stopped; writes are keyed,
so rows that come twice change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orrery.functions.exprs import extension
from orrery.sources.keyed import KeyedTable
from orrery.sources.tables import dimension, latest, shared_dir

RETRIES = 5
HISTORY = 5
REUSE_MS = 30 * 24 * 3600 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PRIORITY, NORMAL = "priority", "normal"
EXHAUSTED = "failed_retries_exhausted"


def run_available(stream: DataFrame, sink: str | None = None, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", checkpoint: str | None = None) -> str:
    """Process everything there is. Rows go to a Parquet sink, or every micro-batch to `each`, which must be idempotent (at least once). Returns the sink's path."""
    spark = stream.sparkSession
    name = uuid.uuid4().hex
    sink = sink or f"{shared_dir(spark)}/sink-{name}"
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/progress-{name}")
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", sink)).start()
    q.awaitTermination()
    return sink


def consume(changes: DataFrame, table: KeyedTable, checkpoint: str, writer: str | None = None) -> None:
    """All changes that are there, merged batch by batch, each exactly once: a batch's number is published with its rows, so one that is delivered again after a crash or a restart is passed over. The checkpoint's name is the writer's, if none is given."""
    writer = writer or checkpoint.rstrip("/")
    run_available(changes, each=lambda df, n: table.merge(df, n, writer), checkpoint=checkpoint)


def route(changes: DataFrame) -> DataFrame:
    """Target delete, none (acl_change) or upsert."""
    return changes.withColumn("target", F.when(F.col("event") == "delete", "delete").when(F.col("event") == "acl_change", "none").otherwise("upsert"))


class ChangedOnly(StatefulProcessor):
    """Passes an upsert on only if its hash differs from the one kept, a delete only if there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", StructType([StructField("hash", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        now = self.hash.get()[0] if self.hash.exists() else None
        out = []
        for r in pdf.itertuples(index=False):
            if r.event == "delete":
                if now is not None:
                    out.append((r.uri, r.seq, "delete", now))
                now = None
            elif r.hash_value != now:
                now = r.hash_value
                out.append((r.uri, r.seq, "upsert", now))
        if now is None:
            self.hash.clear()
        else:
            self.hash.update((now,))
        yield pd.DataFrame(out, columns=["uri", "seq", "action", "hash_value"])

    def close(self) -> None:
        pass


def changed_only(changes: DataFrame) -> DataFrame:
    """Z1 on a stream: (uri, seq, action, hash_value). Needs the RocksDB state store (ROCKS)."""
    schema = StructType([StructField("uri", StringType()), StructField("seq", LongType()), StructField("action", StringType()), StructField("hash_value", StringType())])
    return changes.select("uri", "seq", "event", "hash_value").groupBy("uri").transformWithStateInPandas(ChangedOnly(), schema, "append", "none")


def changed_only_batch(changes: DataFrame) -> DataFrame:
    """Z1 on a whole log, with a window for the state."""
    w = Window.partitionBy("uri").orderBy("seq")
    state = F.when(F.col("event") == "delete", F.lit(None)).otherwise(F.col("hash_value"))
    x = changes.withColumn("_now", state).withColumn("_old", F.lag("_now").over(w))
    kept = x.filter(~F.col("_now").eqNullSafe(F.col("_old")))
    return kept.select("uri", "seq", F.when(F.col("event") == "delete", "delete").otherwise("upsert").alias("action"), F.coalesce("_now", "_old").alias("hash_value"))


def fan_out(changes: DataFrame, plugins: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Z3: a job per active plugin that takes the file's extension, unless the plugin recorded that hash for it. Extensions are an equi-join, whatever the number of plugins."""
    p = plugins.filter("active").select(F.col("name").alias("plugin"), F.explode(F.array_distinct("data_types")).alias("_ext"))
    jobs = changes.filter("event <> 'delete'").join(p, extension(F.col("uri")) == F.col("_ext")).drop("_ext")
    return jobs if done is None else jobs.join(done.select("plugin", "uri", "hash_value"), ["plugin", "uri", "hash_value"], "left_anti")


def reuse_by_content(jobs: DataFrame, results: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs whose content another path was processed with, if that path still has that hash, become copies (plugin, src, uri); the rest stay jobs. results(plugin, uri, hash_value), current(uri, hash_value)."""
    valid = results.join(current, ["uri", "hash_value"], "left_semi").groupBy("plugin", "hash_value").agg(F.min("uri").alias("src"))
    met = jobs.join(valid, ["plugin", "hash_value"], "left").withColumn("src", F.when(F.col("src") != F.col("uri"), F.col("src")))
    return met.filter("src is not null").select("plugin", "src", "uri", "hash_value"), met.filter("src is null").drop("src")


def stale_results(results: DataFrame, current: DataFrame) -> DataFrame:
    """Entries whose path has another hash by now."""
    return results.join(current, ["uri", "hash_value"], "left_anti")


class _Times:
    """Paths in order, each with the time of its result or NEVER, and above them the newest time of every run of paths: a tree in one list."""

    NEVER = -(2**62)

    def __init__(self, times: dict[str, int], others: set[str]):
        self.paths = sorted(times.keys() | others)
        self.at = {p: i for i, p in enumerate(self.paths)}
        self.size = 1 << max(len(self.paths) - 1, 0).bit_length()
        self.newest = [self.NEVER] * self.size + [times.get(p, self.NEVER) for p in self.paths] + [self.NEVER] * (self.size - len(self.paths))
        for i in range(self.size - 1, 0, -1):
            self.newest[i] = max(self.newest[2 * i], self.newest[2 * i + 1])

    def get(self, path: str) -> int:
        return self.newest[self.size + self.at[path]] if path in self.at else self.NEVER

    def put(self, path: str, time: int) -> None:
        i = self.size + self.at[path]
        self.newest[i] = time
        while i > 1:
            i >>= 1
            self.newest[i] = max(self.newest[2 * i], self.newest[2 * i + 1])

    def _first(self, after: int, start: int) -> int | None:
        """The first place from start on whose time is later, in as many steps as the tree is high."""
        i = self.size + start
        while self.newest[i] <= after:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.newest[2 * i] > after else 2 * i + 1
        return i - self.size

    def least(self, after: int, but: str) -> str | None:
        """The least path but that one with a time later than `after`."""
        found = self._first(after, 0)
        if found is not None and self.paths[found] == but:
            found = self._first(after, found + 1) if found + 1 < self.size else None
        return None if found is None else self.paths[found]

    def times(self) -> dict[str, int]:
        return {p: t for p, t in zip(self.paths, self.newest[self.size :]) if t != self.NEVER}


class ContentReuse(StatefulProcessor):
    """Z4 and Z9 for one content hash: which paths were processed with that content, by which plugin and when.

    A result is kept until its path has other content, or until its time is over: a timer takes out what the
    watermark has passed the end of, and no job is given a result that is over at the job's own time, so what a job
    gets doesn't depend on when timers run. Of a path's results the newest counts. A batch reads a content's results
    as one list, looks each job's source up in logarithmic time, and writes the list if it has changed.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.results = handle.getListState("results", "plugin string, uri string, at long")
        self.timer = handle.getValueState("timer", "at long")

    def _kept(self) -> list[tuple[str, str, int]]:
        return [tuple(r) for r in self.results.get()] if self.results.exists() else []

    def _keep(self, results: list[tuple[str, str, int]]) -> None:
        if results:
            self.results.put(results)
            self._wake(min(at for _, _, at in results) + self.ttl)
        else:
            self.results.clear()

    def _wake(self, at: int) -> None:
        """One timer for a key, at the first end of a result."""
        if self.timer.exists():
            known = self.timer.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        out = []
        if key[0] is None:
            out = [(r.plugin, r.uri, r.seq, "run", None, None) for r in pdf.itertuples(index=False) if r.kind == "job"]
            yield pd.DataFrame(out, columns=_REUSE.names)
            return
        old: dict[str, dict[str, int]] = {}
        for plugin, uri, at in self._kept():
            old.setdefault(plugin, {})[uri] = at
        told = pdf[pdf["kind"] == "result"]
        new = {plugin: set(uris) for plugin, uris in told.groupby("plugin")["uri"]}
        held = {p: _Times(old.get(p, {}), new.get(p, set())) for p in old.keys() | new.keys()}
        for r in pdf.itertuples(index=False):
            if r.kind == "job":
                src = held[r.plugin].least(int(r.at) - self.ttl, r.uri) if r.plugin in held else None
                out.append((r.plugin, r.uri, r.seq, "run" if src is None else "copy", src, key[0]))
            elif r.kind == "result":
                held[r.plugin].put(r.uri, max(int(r.at), held[r.plugin].get(r.uri)))
            elif r.kind == "gone":
                for times in held.values():
                    if times.get(r.uri) != times.NEVER:
                        times.put(r.uri, times.NEVER)
        now = {plugin: times.times() for plugin, times in held.items()}
        if any(now[plugin] != old.get(plugin, {}) for plugin in now):
            self._keep([(plugin, uri, at) for plugin in now for uri, at in now[plugin].items()])
        yield pd.DataFrame(out, columns=_REUSE.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.timer.clear()
        held = self._kept()
        self._keep([r for r in held if r[2] + self.ttl > now])
        yield pd.DataFrame([(p, u, None, "evict", None, key[0]) for p, u, at in held if at + self.ttl <= now], columns=_REUSE.names, dtype=object)

    def close(self) -> None:
        pass


_REUSE = StructType([StructField("plugin", StringType()), StructField("uri", StringType()), StructField("seq", LongType()), StructField("action", StringType()), StructField("src", StringType()), StructField("hash_value", StringType())])


def reuse_stream(events: DataFrame, ttl_ms: int = REUSE_MS, late: str = "10 minutes") -> DataFrame:
    """Z4 and Z9 on a stream: (plugin, uri, seq, action, src, hash_value).

    events(kind, plugin, uri, hash_value, seq, ts): a `result` says that a plugin has processed a path with that
    content, `gone` that a path has it no longer (moves() tells), a `job` asks. A job becomes a copy from the least
    other path with a result, or runs; results that are over give `evict`. Within a batch rows count in order of seq;
    a batch holds as much of one content as the source's limits let in. Jobs without a hash run.
    """
    timed = events.select("kind", "plugin", "uri", "hash_value", "seq", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("hash_value").transformWithStateInPandas(ContentReuse(ttl_ms), _REUSE, "append", "eventTime")


class Moves(StatefulProcessor):
    """What content a path had before, whenever it changes or the path goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", StructType([StructField("hash", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now, out = self.hash.get()[0] if self.hash.exists() else None, []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            new = None if r.event == "delete" else r.hash_value
            if now is not None and new != now:
                out.append((key[0], r.seq, now))
            now = new
        self.hash.clear() if now is None else self.hash.update((now,))
        yield pd.DataFrame(out, columns=["uri", "seq", "hash_value"])

    def close(self) -> None:
        pass


def moves(changes: DataFrame) -> DataFrame:
    """Z4 on a stream of changes: (uri, seq, hash_value) of content that a path has no longer: the `gone` events of reuse_stream()."""
    schema = StructType([StructField("uri", StringType()), StructField("seq", LongType()), StructField("hash_value", StringType())])
    return changes.select("uri", "seq", "event", "hash_value").groupBy("uri").transformWithStateInPandas(Moves(), schema, "append", "none")


def with_priority(changes: DataFrame) -> DataFrame:
    """Z5."""
    return changes.withColumn("priority", F.when(F.col("source") == "subscription", PRIORITY).otherwise(NORMAL))


def still_valid(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose hash isn't recorded yet."""
    return jobs.join(done.select("plugin", "uri", "hash_value"), ["plugin", "uri", "hash_value"], "left_anti")


class RetryLimit(StatefulProcessor):
    """Counts deliveries of a hash; after RETRIES of them the job is exhausted, and its hash kept, so that only a changed asset is tried again. State ends with the reuse time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tries = handle.getValueState("tries", StructType([StructField("hash", StringType()), StructField("n", LongType())]), ttlDurationMs=REUSE_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq")
        kept, n = self.tries.get() if self.tries.exists() else (None, 0)
        out = []
        for r in pdf.itertuples(index=False):
            n = n + 1 if r.hash_value == kept else 1
            kept = r.hash_value
            if n <= RETRIES:
                out.append((key[0], r.seq, "retry", kept))
            elif n == RETRIES + 1:
                out.append((key[0], r.seq, EXHAUSTED, kept))
        self.tries.update((kept, n))
        yield pd.DataFrame(out, columns=["uri", "seq", "status", "hash_value"])

    def close(self) -> None:
        pass


def retry_limit(deliveries: DataFrame) -> DataFrame:
    """Z7 on a stream of failed deliveries: (uri, seq, status, hash_value)."""
    schema = StructType([StructField("uri", StringType()), StructField("seq", LongType()), StructField("status", StringType()), StructField("hash_value", StringType())])
    return deliveries.select("uri", "seq", "hash_value").groupBy("uri").transformWithStateInPandas(RetryLimit(), schema, "append", "processingTime")


class StatusHistory(StatefulProcessor):
    """The newest statuses of a key, as a bounded list; each batch gives the key's list as it is now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", StructType([StructField("seq", LongType()), StructField("status", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        old = [tuple(x) for x in self.items.get()] if self.items.exists() else []
        new = [(int(s), t) for pdf in rows for s, t in zip(pdf["seq"], pdf["status"])]
        kept = sorted(set(old + new), reverse=True)[:HISTORY]
        self.items.put(kept)
        yield pd.DataFrame([(key[0], s, t) for s, t in kept], columns=["uri", "seq", "status"])

    def close(self) -> None:
        pass


def status_history(statuses: DataFrame) -> DataFrame:
    """Z8 on a stream."""
    schema = StructType([StructField("uri", StringType()), StructField("seq", LongType()), StructField("status", StringType())])
    return statuses.select("uri", "seq", "status").groupBy("uri").transformWithStateInPandas(StatusHistory(), schema, "update", "none")


def live_entries(entries: DataFrame, now, ttl_days: int = 30) -> DataFrame:
    """Z9 on a table: entries of the last days."""
    return entries.filter(F.col("ts") > now - F.make_dt_interval(F.lit(ttl_days)))


def write_back(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results(plugin, uri, seq, hash_value, content) to the last content of each plugin and uri (null content: a delete), and the path-to-hash rows to record with it."""
    last = latest(results, ["plugin", "uri"], F.col("seq"))
    return last.withColumn("action", F.when(F.col("content").isNull(), "delete").otherwise("upsert")), last.select("plugin", "uri", "hash_value")


def replace_by_producer(assets: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """A plugin's new views take the place of its old ones. assets(key, views), new(key, plugin, views); views have a field producer."""
    g = new.groupBy(key).agg(F.collect_set("plugin").alias("_who"), F.flatten(F.collect_list("views")).alias("_new"))
    met = assets.join(g, key, "left")
    kept = F.filter("views", lambda v: ~F.coalesce(F.array_contains("_who", v["producer"]), F.lit(False)))
    return met.withColumn("views", F.when(F.col("_new").isNull(), F.col("views")).otherwise(F.concat(kept, "_new"))).drop("_who", "_new")


def debounce(changes: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """One row per burst of changes of a path: its window, changes, last event."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "uri").agg(F.count("*").alias("n"), F.max_by("event", "seq").alias("event")).select("uri", F.col("w.start").alias("start"), "n", "event")


def sync_status(listing: DataFrame, done: DataFrame, plugins: DataFrame) -> DataFrame:
    """For each plugin and uri not_found, in_sync or out_of_sync by the recorded and the current hash. plugins: a table of settings, its size is checked."""
    pairs = listing.select("uri", F.col("hash_value").alias("_now")).join(dimension(plugins.select(F.col("name").alias("plugin"))))
    met = pairs.join(done.select("plugin", "uri", F.col("hash_value").alias("_done")), ["plugin", "uri"], "left")
    return met.select("plugin", "uri", F.when(F.col("_done").isNull(), "not_found").when(F.col("_done") == F.col("_now"), "in_sync").otherwise("out_of_sync").alias("sync"))


def reprocess(by_status: DataFrame, done: DataFrame, pattern: str | None = None, formats: list[str] | None = None, plugins: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """by_status(status, uri, plugins) of A13: the chosen pairs as priority jobs, and the recorded hashes without theirs."""
    pairs = by_status.select("uri", F.explode("plugins").alias("plugin"))
    if pattern is not None:
        pairs = pairs.filter(F.col("uri").rlike(pattern))
    if formats is not None:
        pairs = pairs.filter(extension(F.col("uri")).isin(formats))
    if plugins is not None:
        pairs = pairs.filter(F.col("plugin").isin(plugins))
    pairs = pairs.distinct()
    return pairs.withColumn("priority", F.lit(PRIORITY)), done.join(pairs, ["plugin", "uri"], "left_anti")
