"""A folder as a stream of changes. Listing again gives creates, updates and deletes, batch by batch.

An offset is a snapshot: a listing that is written, dealt into parts by path, before the offset is told. A batch is
the difference of two snapshots, part by part in tasks of its own; started again from a checkpoint, it is the same
difference. Snapshots that no batch starts from any more are deleted.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHANGE = "uri string, event string, hash_value string, size long, snapshot long"
_ROW = pa.schema([("uri", pa.string()), ("hash_value", pa.string()), ("size", pa.int64())])
#: Rows of a part that are written together.
ROWS = 50_000


class Part(InputPartition):
    def __init__(self, start: int, end: int, part: int):
        self.start, self.end, self.part = start, end, part


class ListingReader(DataSourceStreamReader):
    """Options: path, state (a shared folder for snapshots), parts, ignore (patterns, one a line), showHidden."""

    def __init__(self, options: dict):
        self.root, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.parts = int(options.get("parts", 8))
        self.ignore = [p for p in options.get("ignore", "").split("\n") if p]
        self.hidden = options.get("showhidden", options.get("showHidden", "false")).lower() == "true"

    def _snapshots(self) -> list[int]:
        files, base = fs.FileSystem.from_uri(self.state)
        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(f.base_name.removeprefix("done-")) for f in found if f.base_name.startswith("done-"))

    def _wanted(self, uri: str) -> bool:
        return not any(re.search(p, uri) for p in self.ignore) and (self.hidden or not re.search(r"/\.[^/]", uri[len(self.root) :]))

    def _entries(self) -> Iterator[tuple[str, str, int]]:
        """Files under the root, a folder at a time."""
        files, base = fs.FileSystem.from_uri(self.root)
        folders = [base]
        while folders:
            for f in files.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True)):
                if f.type == fs.FileType.Directory:
                    folders.append(f.path)
                elif f.type == fs.FileType.File:
                    uri = self.root + f.path[len(base) :]
                    if self._wanted(uri):
                        yield uri, f"{uri}/{f.mtime_ns}", f.size

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        """List now; a new snapshot if anything is other than in the last one."""
        files, base = fs.FileSystem.from_uri(self.state)
        folder = f"{base}/listing-{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        held: list[list] = [[] for _ in range(self.parts)]
        writers = [pq.ParquetWriter(f"{folder}/{p}.parquet", _ROW, filesystem=files) for p in range(self.parts)]
        digest = count = 0

        def flush(p: int) -> None:
            writers[p].write_table(pa.table(list(zip(*held[p])) or [[], [], []], schema=_ROW))
            held[p].clear()

        for row in self._entries():
            p = zlib.crc32(row[0].encode()) % self.parts
            held[p].append(row)
            count += 1
            digest = (digest + int.from_bytes(uuid.uuid5(uuid.NAMESPACE_URL, row[1]).bytes, "big")) % 2**128  # the order of folders doesn't matter
            if len(held[p]) >= ROWS:
                flush(p)
        for p, w in enumerate(writers):
            flush(p)
            w.close()
        known = self._snapshots()
        told = f"{digest:032x} {count}"
        if known:
            with files.open_input_stream(f"{base}/done-{known[-1]}") as f:
                if f.read().decode().split(" ", 1)[1] == told:
                    files.delete_dir(folder)
                    return {"snapshot": known[-1]}
        new = (known[-1] if known else 0) + 1
        with files.open_output_stream(f"{base}/tmp-{new}") as f:
            f.write(f"{folder.rsplit('/', 1)[1]} {told}".encode())
        files.move(f"{base}/tmp-{new}", f"{base}/done-{new}")
        return {"snapshot": new}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["snapshot"], end["snapshot"], p) for p in range(self.parts)] if end["snapshot"] > start["snapshot"] else []

    def _part(self, snapshot: int, part: int) -> dict[str, tuple[str, int]]:
        if not snapshot:
            return {}
        files, base = fs.FileSystem.from_uri(self.state)
        with files.open_input_stream(f"{base}/done-{snapshot}") as f:
            folder = f.read().decode().split(" ")[0]
        t = pq.read_table(f"{base}/{folder}/{part}.parquet", filesystem=files)
        return {u: (h, s) for u, h, s in zip(*(t.column(c).to_pylist() for c in ("uri", "hash_value", "size")))}

    def read(self, partition: Part) -> Iterator[tuple]:
        old, new = self._part(partition.start, partition.part), self._part(partition.end, partition.part)
        for uri, (h, size) in new.items():
            if uri not in old:
                yield uri, "create", h, size, partition.end
            elif old[uri][0] != h:
                yield uri, "update", h, size, partition.end
        for uri, (h, size) in old.items():
            if uri not in new:
                yield uri, "delete", h, size, partition.end

    def commit(self, end: dict) -> None:
        files, base = fs.FileSystem.from_uri(self.state)
        for n in self._snapshots():
            if n < end["snapshot"]:
                with files.open_input_stream(f"{base}/done-{n}") as f:
                    folder = f.read().decode().split(" ")[0]
                files.delete_file(f"{base}/done-{n}")
                files.delete_dir(f"{base}/{folder}")


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema) -> ListingReader:
        return ListingReader({k: v for k, v in self.options.items()})


def listing_stream(spark: SparkSession, path: str, state: str, *, parts: int = 8, ignore: list[str] = (), show_hidden: bool = False):
    """A stream of (uri, event, hash_value, size, snapshot) of what changes under a folder, in any store that Arrow can list. Each trigger lists again; hash_value is the path with its time of change. Hidden and ignored paths are left out as in list_assets(). More parts make more tasks, each of which holds its part of two listings."""
    spark.dataSource.register(Listing)
    options = {"path": path, "state": state, "parts": str(parts), "ignore": "\n".join(ignore), "showHidden": str(show_hidden).lower()}
    return spark.readStream.format("listing").options(**options).load()
