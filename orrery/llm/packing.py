"""Bounded-space online packing of tokenised documents into fixed windows.

Every task tokenises its documents and packs them as they come, holding a fixed number of open
windows: a document's remainder goes to the window it fits best; when none fits and no more may be
opened, the fullest is topped up with the beginning of that remainder and emitted. What stays open at
a task's end is closed up, so each task leaves less than one window; those leftovers are merged in
groups of a fixed number of tasks, level by level, and the last of them is cut into sequences whose
lengths are powers of two, which need no padding. Token ids never enter a shuffle but for leftovers.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, texts, written

WINDOW = 2048
OPEN_WINDOWS = 64
#: Leftovers of so many tasks are merged by one task.
MERGE = 256
END = 1
SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN = f"{PIECES}, part long, ids binary"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")), ("ids", pa.binary())])


def default_vocabulary() -> str:
    """The byte-level BPE of 50,257 ids, as ranks: the same ids as the JSON file of that tokenizer gives."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})

    def encode(text: str) -> list[int]:
        return enc.encode(text, allowed_special={SPECIAL}) if SPECIAL in text else enc.encode_ordinary(text)

    return encode


class Packer:
    """Open windows of one task. A piece is (doc, start, ids, doc's length)."""

    def __init__(self, window: int, most_open: int, first_id: int, part: int):
        self.window, self.most_open, self.next_id, self.part = window, most_open, first_id, part
        self.open: list[list] = []
        self.free: list[int] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list, keep_ids: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_id, offset, self.part, raw if keep_ids else None))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[: self.window], total)])
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            n = len(ids)
            best = min((i for i, f in enumerate(self.free) if f >= n), key=self.free.__getitem__, default=None)
            if best is None and len(self.open) < self.most_open:
                self.open.append([])
                self.free.append(self.window)
                best = len(self.open) - 1
            top_up = best is None
            if top_up:
                best = min(range(len(self.free)), key=self.free.__getitem__)
            take = min(n, self.free[best])
            self.open[best].append((doc, start, ids[:take], total))
            self.free[best] -= take
            ids, start = ids[take:], start + take
            if not self.free[best]:
                self.emit(self.open.pop(best))
                self.free.pop(best)

    def close(self, last: bool) -> None:
        """Close up what is open. Under a window stays: as leftovers, or cut into powers of two."""
        pieces = [p for w in self.open for p in w]
        self.open, self.free, self.most_open = [], [], 1
        for p in pieces:
            self.add(*p)
        rest = self.open.pop() if self.open else []
        self.free = []
        if not last:
            if rest:
                self.emit(rest, keep_ids=True)
            return
        left = sum(len(p[2]) for p in rest)
        while left:
            size, sequence = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, start, ids, total = rest.pop(0)
                take = min(size, len(ids))
                sequence.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.insert(0, (doc, start + take, ids[take:], total))
                size -= take
            self.emit(sequence)

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def pack(documents: DataFrame, *, vocabulary: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and then the end id. Null and empty texts are the end id alone; rows
    with equal ids, or without one, are packed each for itself; bytes that are no UTF-8 read as U+FFFD; other
    columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        packer = Packer(window, open_windows, part << 32, part)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for t in texts(batch, "text"):
                raw = t.data.tobytes()
                for k in range(t.lo, t.hi):
                    a, b = t.offsets[k - t.lo], t.offsets[k - t.lo + 1]
                    ids = encode(raw[a:b].decode(errors="replace"))
                    ids.append(END)
                    packer.add(ids_of[k], 0, np.array(ids, "<u4"), len(ids))
                yield packer.drain()
        packer.close(last=False)
        yield packer.drain()

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = written(spread(rows).mapInArrow(tokenise, _OPEN), "packed")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    done = [packed.filter("ids is null")]
    open_, level = packed.filter("ids is not null"), 0
    while True:
        level += 1
        parts = -(-parts // MERGE)
        last, at = parts <= 1, level << 56

        def merge(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["offset"]))
            group = rows[0]["part"] // MERGE
            packer = Packer(window, 1, at + (group << 32), group)
            for r in rows:
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            packer.close(last)
            return pa.Table.from_batches([packer.drain()])

        merged = open_.groupBy(F.floor(F.col("part") / MERGE)).applyInArrow(merge, _OPEN)
        if last:
            done.append(merged)
            break
        merged = written(merged, f"merged{level}")
        done.append(merged.filter("ids is null"))
        open_ = merged.filter("ids is not null")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part", "ids")
