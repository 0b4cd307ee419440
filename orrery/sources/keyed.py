"""Keyed tables that outlive the process: part files, tombstones and a log of snapshots, each published at once or not at all."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.tables import discard, latest, shared_dir, written

#: Times that a merge is tried again after another writer published first.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer published this version."""


class Files:
    """The few calls of the cluster's file system that a log needs, for any scheme that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def age_ms(self, name: str) -> int:
        return self._jvm.java.lang.System.currentTimeMillis() - self._fs.getFileStatus(self._path(name)).getModificationTime()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that doesn't exist yet; readers see all of it or none. Conflict if it exists."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        no = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)  # none of its options: don't replace
        try:
            context.rename(self._path(part), self._path(name), no)
        except Exception as e:
            taken = self._fs.exists(self._path(name))
            self._fs.delete(self._path(part), False)
            if taken:
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Snapshot:
    """A version: the folder of each part, how many parts there are, and the last batch that each writer has merged."""

    version: int = 0
    parts: int = 16
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "parts": self.parts, "folders": self.folders, "batches": self.batches}, sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Snapshot:
        d = json.loads(text)
        return cls(d["version"], d["parts"], {int(k): v for k, v in d["folders"].items()}, d["batches"])


class KeyedTable:
    """A keyed Parquet table that batches are merged into.

    Keys are dealt over parts by hash, and a merge writes only the parts that its keys are of, each as a new folder.
    A deleted key stays as a tombstone with its order, so that a change that is older than the delete stays undone.

    All there is to know lies in `path`: data in folders that never change, and a log with one file per version that
    says which folders make it. A version is published by a rename that doesn't replace, so a crash before it leaves
    the last version as it was and one after it leaves the new one, and of two writers one is first and the other
    merges again. A batch carries its writer's name and number, which are published with it: delivered again, it
    is passed over. A new object, in this process or another, goes on from the last version.
    """

    def __init__(self, spark: SparkSession, schema: str, key: str | list[str], order: str, parts: int = 16, path: str | None = None):
        self.spark, self.schema, self.order = spark, schema, order
        self.keys = [key] if isinstance(key, str) else list(key)
        self.path = (path or f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}").rstrip("/")
        self._files, self._parts = Files(spark, self.path), parts

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._files.names("log") if n.endswith(".json") and n[0] != "."]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last version, or an older one that is kept; an empty one if nothing was published."""
        known = self.versions()
        if version is None and not known:
            return Snapshot(parts=self._parts)
        return Snapshot.of(self._files.read(f"log/{known[-1] if version is None else version:020d}.json"))

    @property
    def folders(self) -> dict[int, str]:
        """The folder of each part, as of now."""
        return self.snapshot().folders

    def _publish(self, new: Snapshot) -> None:
        self._files.publish(f"log/{new.version:020d}.json", new.text())

    def _rows(self, of: Snapshot, parts: list[int] | None = None) -> DataFrame:
        schema = f"{self.schema}, _deleted boolean"
        folders = [f"{self.path}/data/{f}" for p, f in sorted(of.folders.items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int")

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.snapshot(version)).filter("not _deleted").drop("_deleted")

    def _write(self, rows: DataFrame, parts: int, tasks: int) -> str:
        folder = uuid.uuid4().hex
        rows.withColumn("_part", self._part(parts)).repartition(tasks, "_part").write.partitionBy("_part").parquet(f"{self.path}/data/{folder}")
        return folder

    def merge(self, changes: DataFrame, batch: int | None = None, writer: str = "stream") -> bool:
        """changes has the table's columns and `event`; delete removes, everything else replaces; the last of a key by order counts, and none that is older than what is there, be it a row or a delete. Rows without a key are ignored.

        batch: the number of a writer's batch, which rises; one that is merged already changes nothing. Returns whether a version was published.
        """
        if batch is not None and self.snapshot().batches.get(writer, -1) >= batch:
            return False
        known = changes.filter(" and ".join(f"`{k}` is not null" for k in self.keys))
        last = written(latest(known, self.keys, F.col(self.order)), "changes")
        try:
            for _ in range(TRIES):
                old = self.snapshot()
                if batch is not None and old.batches.get(writer, -1) >= batch:
                    return False
                touched = [r.part for r in last.select(self._part(old.parts).alias("part")).distinct().collect()]  # at most `parts`
                if not touched and batch is None:
                    return False
                folders = self._merged(last, old, touched) if touched else {}
                batches = old.batches if batch is None else old.batches | {writer: batch}
                try:
                    self._publish(replace(old, version=old.version + 1, folders=old.folders | folders, batches=batches))
                    return True
                except Conflict:
                    continue
            raise Conflict(f"{TRIES} other writers were first")
        finally:
            discard(last)

    def _merged(self, last: DataFrame, old: Snapshot, touched: list[int]) -> dict[int, str]:
        rows = self._rows(old, touched)
        at = rows.select(*self.keys, F.col(self.order).alias("_at"))
        news = last.join(at, self.keys, "left").filter(F.col("_at").isNull() | (F.col(self.order) >= F.col("_at")))
        kept = rows.join(news.select(*self.keys), self.keys, "left_anti").select(*rows.columns)
        new = news.withColumn("_deleted", F.col("event") == "delete").select(*rows.columns)
        folder = self._write(kept.unionByName(new), old.parts, len(touched))
        return {p: f"{folder}/_part={p}" for p in touched}

    def compact(self, parts: int | None = None, forget=None) -> None:
        """A version with as many parts as are asked for (a table that has grown takes more), without tombstones whose order is less than `forget`: changes older than that must not come any more."""
        old = self.snapshot()
        parts, rows = parts or old.parts, self._rows(old)
        rows = rows if forget is None else rows.filter(~F.col("_deleted") | (F.col(self.order) >= F.lit(forget)))
        folder = self._write(rows, parts, parts)
        there = [int(n.split("=")[1]) for n in self._files.names(f"data/{folder}") if n.startswith("_part=")]
        self._publish(replace(old, version=old.version + 1, parts=parts, folders={p: f"{folder}/_part={p}" for p in there}))

    def vacuum(self, keep: int = 1, older_ms: int = 3_600_000) -> int:
        """Delete all versions but the last `keep`, and folders that no kept version names: old parts, and what crashes left behind. Younger folders than older_ms stay, as a writer may be about to publish them. Returns how many folders went."""
        known = self.versions()
        kept = known[-max(keep, 1) :]
        named = {f.split("/")[0]: set() for v in kept for f in self.snapshot(v).folders.values()}
        for v in kept:
            for f in self.snapshot(v).folders.values():
                named[f.split("/")[0]].add(f.split("/")[1])
        for v in known[: -max(keep, 1)]:
            self._files.delete(f"log/{v:020d}.json")
        for n in self._files.names("log"):
            if n.endswith(".tmp") and self._files.age_ms(f"log/{n}") >= older_ms:
                self._files.delete(f"log/{n}")
        gone = 0
        for folder in self._files.names("data"):
            old = self._files.age_ms(f"data/{folder}") >= older_ms
            if folder not in named and old:
                self._files.delete(f"data/{folder}")
                gone += 1
            elif folder in named:
                for part in self._files.names(f"data/{folder}"):
                    if part.startswith("_part=") and part not in named[folder] and old:
                        self._files.delete(f"data/{folder}/{part}")
                        gone += 1
        return gone
