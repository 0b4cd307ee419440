"""A15, live: what running queries have read, as a table that grows with every micro-batch."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from orrery.sources.keyed import Conflict, Files

SCHEMA = "consumer string, query string, batch long, at timestamp, rows long, read long, processed long, last_seq long, offsets string"
_METRIC = "consumer"


def tracked(stream: DataFrame, seq: str = "seq", done: Column | None = None) -> DataFrame:
    """The stream with what a ProgressLog tells of it: rows read, rows done (all, if nothing else is said), the last sequence number. Counted on the way, with no pass of its own."""
    return stream.observe(_METRIC, F.count(F.lit(1)).alias("read"), F.count_if(F.lit(True) if done is None else done).alias("processed"), F.max(F.col(seq).cast("long")).alias("last_seq"))


class ProgressLog(StreamingQueryListener):
    """Writes a row for every micro-batch of a named query into a folder, once: a batch that is run again after a crash has its row already.

    spark.streams.addListener(log) before queries start; the folder outlives the process. Consumers are queries' names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._files = spark, folder.rstrip("/"), Files(spark, folder)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(_METRIC)
        if p.name is None or (seen is None and not p.numInputRows):
            return
        told = seen.asDict() if seen is not None else {}
        offsets = [{"source": s.description, "start": s.startOffset, "end": s.endOffset, "latest": s.latestOffset} for s in p.sources]
        row = {"consumer": p.name, "query": str(p.id), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "read": told.get("read", p.numInputRows), "processed": told.get("processed", p.numInputRows), "last_seq": told.get("last_seq"), "offsets": json.dumps(offsets)}
        try:
            self._files.publish(f"{p.id}-{p.batchId:012d}.json", json.dumps(row))
        except Conflict:
            pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def settle(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the rows of a query's batches so far are written: listeners run behind queries."""
        last = query.lastProgress
        name = last and f"{last.id}-{last.batchId:012d}.json"
        until = time.monotonic() + seconds
        while name and last.numInputRows and name not in self._files.names(""):
            if time.monotonic() > until:
                raise TimeoutError(name)
            time.sleep(0.05)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(f"{self.folder}/*.json") if self._files.names("") else self.spark.createDataFrame([], SCHEMA)


def run_tracked(stream: DataFrame, name: str, log: ProgressLog, checkpoint: str, each=lambda df, n: df.write.format("noop").mode("append").save(), seq: str = "seq", done: Column | None = None) -> None:
    """Everything there is, as consumer `name`, with its progress in the log when this returns."""
    q = tracked(stream, seq, done).writeStream.queryName(name).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(each).start()
    q.awaitTermination()
    log.settle(q)


def live_progress(log: DataFrame, progress: DataFrame) -> DataFrame:
    """A15 of running consumers: log(seq), progress as of ProgressLog.rows(): batches, read, processed, lag in rows behind the log, percent done, last_seq and how far it is behind the newest."""
    total = log.agg(F.count("*").alias("total"), F.max("seq").alias("newest"))
    g = progress.groupBy("consumer").agg(F.count("*").alias("batches"), F.sum("read").alias("read"), F.sum("processed").alias("processed"), F.max("last_seq").alias("last_seq"), F.max("at").alias("at"))
    met = g.join(F.broadcast(total))  # one row
    return met.select("consumer", "batches", "read", "processed", (F.col("total") - F.col("read")).alias("lag"), (100.0 * F.col("processed") / F.greatest("total", F.lit(1))).alias("percent"), "last_seq", (F.col("newest") - F.col("last_seq")).alias("behind"), "at")
