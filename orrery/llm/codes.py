"""Vector codes: product quantisation in whole numbers, with exact nearest entries by slices and bitmasks.

Of every dimension of a codebook the entries' coordinates are sorted, and each place in that order carries a
mask of the entries before it. A vector part and a radius select a range per dimension; the range's entries
are the difference of two masks, and the AND over dimensions leaves the entries of a box that holds all
within the radius. If the nearest of them is within it, it is the nearest of all; else the radius becomes
its distance, or is doubled where the box was empty, and only those parts are looked at again.

Each round reads the vectors once. A task passes on one sum per entry and component, so what is shuffled
and what the driver sees is as large as the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_class, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries that one mask holds.
MASK_BITS = 64
#: Components are below this after scaling, so that squared distances stay whole.
MOST = 1 << 26
_U = np.uint64


def usable(vector: Column, width: int | None = None) -> Column:
    """No null, no null or non-finite component, at least one component (with width, so many)."""
    sized = F.size(vector) > 0 if width is None else F.size(vector) == width
    return vector.isNotNull() & sized & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


class Codebook:
    """The entries of one part, and each dimension's sorted coordinates with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        by = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, by, 0)
        self.masks = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        np.bitwise_or.accumulate(_U(1) << by.astype(np.uint64), axis=0, out=self.masks[1:])
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        near = apart.min(1)
        near = near[np.isfinite(near)]
        self.radius = int(np.sqrt(np.median(near))) if len(near) else 0

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries no further than the radius in any dimension."""
        out = np.full(len(x), self.masks[-1, 0])
        for d in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            out &= self.masks[hi, d] & ~self.masks[lo, d]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, ties to the lower index."""
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        none = np.iinfo(np.int64).max
        while len(todo):
            part = x[todo]
            mask = self.box(part, radius)
            found, which = np.full(len(todo), none), np.zeros(len(todo), np.int64)
            for j in range(len(self.entries)):
                on = np.flatnonzero(mask >> _U(j) & _U(1))
                apart = ((part[on] - self.entries[j]) ** 2).sum(1)
                better = apart < found[on]
                found[on[better]], which[on[better]] = apart[better], j
            within = found <= radius * radius
            index[todo[within]], best[todo[within]] = which[within], found[within]
            rest = ~within
            wider = np.where(found < none, np.ceil(np.sqrt(np.minimum(found, 1 << 62).astype(np.float64))).astype(np.int64) + 1, 2 * radius + 1)
            todo, radius = todo[rest], wider[rest]
        return index, best


@dataclass
class Codebooks:
    """entries: parts x entries x width of a part, whole numbers."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def books(self) -> list[Codebook]:
        return [Codebook(e) for e in self.entries]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole(batch: pa.RecordBatch, column: str, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are usable, and their vectors in whole numbers."""
    col = batch.column(batch.schema.get_field_index(column))
    ok = pc.fill_null(pc.equal(pc.list_value_length(col), width), False)
    at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    x = pc.fill_null(pc.list_flatten(col.take(pa.array(at))).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(at), width)
    fine = np.isfinite(x).all(1)
    at, x = at[fine], np.floor(x[fine] * scale)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"components must be below {MOST // scale} in size")
    return at, x.astype(np.int64)


def fit(embeddings: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks of each part by rounds of k-means over all rows, begun with the vectors of the least ids (ties by vector; rows without an id come last).

    A vector is cut into equal consecutive parts. Each component becomes floor(scale * component); a round gives
    every part to its nearest entry (ties to the lower index) and makes each entry the mean of its parts, rounded
    down; an entry without parts stays. The width is that of the least id; vectors that are null, empty or hold
    null or non-finite components, and such of another width, take no part. Without any, the codebooks are empty.
    """
    if not 0 < entries <= MASK_BITS:
        raise ValueError(f"a codebook has 1 to {MASK_BITS} entries")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    order = [F.asc_nulls_last("id"), F.col("vector")]
    first = rows.filter(usable(F.col("vector"))).orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    width = len(first[0].vector)
    if width % parts:
        raise ValueError(f"{width} components can't be cut into {parts} equal parts")
    begin = rows.filter(usable(F.col("vector"), width)).orderBy(*order).limit(entries).collect()  # a codebook's entries at most
    start = np.floor(np.array([r.vector for r in begin], np.float64) * scale)
    if np.abs(start).max() >= MOST:
        raise ValueError(f"components must be below {MOST // scale} in size")
    now = start.astype(np.int64).reshape(len(begin), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        now = _moved(rows, now, width, scale)
    return Codebooks(now, scale)


def _moved(rows: DataFrame, now: np.ndarray, width: int, scale: int) -> np.ndarray:
    """One round over rows(id, vector)."""
    parts, entries, size = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Codebooks(now, scale).books()
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            _, x = whole(batch, "vector", width, scale)
            for p, book in enumerate(books):
                part = x[:, p * size : (p + 1) * size]
                index, _ = book.nearest(part)
                by = np.argsort(index, kind="stable")
                got, starts = np.unique(index[by], return_index=True)
                count[p] += np.bincount(index, minlength=entries)
                if len(got):
                    total[p][got] += np.add.reduceat(part[by], starts, axis=0)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    sums = rows.select("vector").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("position", "component")).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("component").alias("component"))
    out = now.copy()
    for r in sums.collect():  # a row per component of the codebooks
        out[r.part, r.entry, r.position] = r.component // r.n
    return out


def encode(embeddings: DataFrame, codebooks: Codebooks, *, id_col: str = "vec_id", vector_col: str = "embedding", keep: list[str] = ()) -> DataFrame:
    """vec_id, code (two hex digits per part), error (squared distances summed over parts) of every usable vector of the codebooks' width; with the columns in keep. An empty codebook gives no rows."""
    shown = [f"kept_{k}" for k in range(len(keep))]
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), *(F.col(f"`{c}`").alias(s) for c, s in zip(keep, shown)))
    schema = "vec_id long, code string, error long" + "".join(f", {s} {rows.schema[s].dataType.simpleString()}" for s in shown)
    shared = embeddings.sparkSession.sparkContext.broadcast(codebooks)
    names = ["vec_id", "code", "error", *shown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Codebooks = shared.value
        if not model.width:
            return
        books, size = model.books(), model.entries.shape[2]
        for batch in batches:
            at, x = whole(batch, "vector", model.width, model.scale)
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                codes[:, p], apart = book.nearest(x[:, p * size : (p + 1) * size])
                error += apart
            kept = [batch.column(batch.schema.get_field_index(s)).take(pa.array(at)) for s in shown]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error), *kept], names)

    out = rows.mapInArrow(run, schema)
    return out.select("vec_id", "code", "error", *(F.col(s).alias(c) for c, s in zip(keep, shown)))


def decode(code: str, codebooks: Codebooks) -> np.ndarray:
    """The vector that a code stands for: the middle of its entries' steps."""
    index = np.frombuffer(bytes.fromhex(code), np.uint8)
    return (codebooks.entries[np.arange(len(index)), index].ravel() + 0.5) / codebooks.scale


def compress(embeddings: DataFrame, *, label_col: str = "label", id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error (error summed over equal labels, nulls together), codebooks_sha256. Codebooks as of fit(). Rows that repeat an id, or have none, get a row each; other columns are ignored; an empty table gives no rows."""
    model = fit(embeddings, id_col=id_col, vector_col=vector_col, **options)
    one = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    coded = written(encode(one, model, keep=["label"]), "codes")
    totals = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return by_class(coded, totals, "label").select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
