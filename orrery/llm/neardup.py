"""Near duplicates by word shingles: fast similarity sketches, banding, exact verification, components.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round i < t every element is thrown into one of t bins with
a value in [i, i+1); a bin keeps its least value, and rounds go on until every bin is filled. Rounds t to
2t-1 throw everything into bin i-t, so every coordinate of any set that isn't empty is filled.

Texts with equal shingle sets fall together before anything else, so a group of exact copies costs one
row per task. Band buckets are then linked to their least member, which makes families that hold every
candidate pair; a family's full sets meet in one task, which confirms links set against set and passes
over pairs that are already connected. A family larger than a task may hold is cut into chunks, and
every pair of chunks meets in a task of its own, so no candidate is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, mix, shingles, spread, texts, words, written
from .components import connected_components

BANDS, ROWS = 48, 6
#: Shingles, and documents, that one verifying task holds at most, but for two single documents.
TASK_SHINGLES, TASK_DOCS = 4_000_000, 50_000
_FULL = np.uint64(2**64 - 1)
_U = np.uint64


def sketches(h: np.ndarray, doc: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """A row of `bins` values for each of `docs` sets; elements h of set doc. Rows of empty sets stay full."""
    out = np.full(docs * bins, _FULL)
    open_ = np.zeros(docs, bool)
    open_[doc] = True
    for i in range(2 * bins):
        if i:
            keep = open_[doc]
            h, doc = h[keep], doc[keep]
        if not len(h):
            break
        g = mix(h + _U(i * 0x9E3779B97F4A7C15 % 2**64))
        at = ((g >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(out, doc * bins + at, (g & _U(0xFFFFFFFF)) | _U(i << 32))
        open_ &= (out.reshape(docs, bins) == _FULL).any(1)
    return out.reshape(docs, bins)


def _sets(t, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ordered by text and hash."""
    h, doc = shingles(words(t, NOT_SPACE), size)
    by = np.argsort(h)
    by = by[np.argsort(doc[by], kind="stable")]
    h, doc = h[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _keys(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = s.reshape(len(s), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _U(0x2545F4914F6CDD1D)
    for k in range(rows):
        key = mix(key + s[:, :, k])
    return key.view(np.int64)


def sketch_table(documents: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a 128-bit digest of the set), keys (a bucket per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                n = t.hi - t.lo
                h, doc = _sets(t, size)
                first = np.searchsorted(doc, np.arange(n + 1))
                keys = _keys(sketches(h, doc, n, bands * rows), bands, rows)
                full = np.diff(first) > 0
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(full * bands)].astype(np.int32), pa.array(keys[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, n), pa.array(np.diff(first)), pa.array(_sums(mix(h), first)), pa.array(_sums(mix(h ^ _U(0xA5A5A5A5)), first)), lists], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>")


def _linked(a: np.ndarray, inter: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def verified_links(doc: np.ndarray, sizes: np.ndarray, elements: np.ndarray, keys: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links that connect what is connected, each between sets that share a bucket. side: with it, only sets of two sides are held together.

    Bucket by bucket: a pair is looked at in the first band that it shares, and only while it isn't connected, so a
    bucket of copies costs one comparison for each and a text without copies none.
    """
    n = len(doc)
    _, ids = np.unique(elements, return_inverse=True)
    first = np.r_[0, np.cumsum(sizes)]
    parent = np.arange(n)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)
    out = []

    def roots(v: np.ndarray) -> np.ndarray:
        r = parent[v]
        while (parent[r] != r).any():
            r = parent[r]
        parent[v] = r
        return r

    def compare(x: int, y: np.ndarray) -> None:
        mark[ids[first[x] : first[x + 1]]] = True
        start = np.r_[0, np.cumsum(sizes[y])]
        at = np.arange(start[-1]) - np.repeat(start[:-1], sizes[y]) + np.repeat(first[y], sizes[y])
        inter = np.add.reduceat(mark[ids[at]].astype(np.int64), start[:-1])
        mark[ids[first[x] : first[x + 1]]] = False
        for k in y[_linked(sizes[x], inter, sizes[y], percent)].tolist():
            a, b = roots(np.array([x, k]))
            if a != b:
                out.append((int(doc[x]), int(doc[k])))
                parent[max(a, b)] = min(a, b)

    for band in range(keys.shape[1]):
        by = np.argsort(keys[:, band], kind="stable")
        new = np.flatnonzero(np.r_[True, keys[by[1:], band] != keys[by[:-1], band]])
        root = roots(by)
        open_ = np.flatnonzero(np.minimum.reduceat(root, new) != np.maximum.reduceat(root, new))
        for a, b in zip(new[open_], np.r_[new[1:], n][open_]):
            bucket = by[a:b]
            for k, x in enumerate(bucket[:-1].tolist()):
                later = bucket[k + 1 :]
                y = later[roots(later) != roots(bucket[k : k + 1])]
                if not len(y):
                    break
                y = y[100 * np.minimum(sizes[y], sizes[x]) >= percent * np.maximum(sizes[y], sizes[x])]
                if side is not None:
                    y = y[side[y] != side[x]]
                if band and len(y):
                    y = y[~(keys[y, :band] == keys[x, :band]).any(1)]
                if len(y):
                    compare(x, y)
    return out


def near_duplicates(documents: DataFrame, *, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, task_shingles: int = TASK_SHINGLES, task_docs: int = TASK_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct shingles; component_id
    is the least id reachable. A pair at the threshold shares no band with probability (1 - 0.8^rows)^bands,
    under 5e-7 as set. Null, empty and blank texts have no shingles and no links; texts of fewer words than a
    shingle are one shingle. An id is a node: of rows that repeat it with other texts, the one of least digest is
    linked, and all get its component. Rows without an id have the component of an equal text with one, else none,
    and are kept then. Other columns are ignored; an empty table gives no rows.
    """
    base = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(sketch_table(base, shingle_words, bands, rows), "sketches")
    same = ["d1", "d2", "n_shingles"]
    classes = written(table.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    reps = table.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi")
    reps = reps.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles", "keys")).alias("r")).select("doc_id", "r.*")
    met = reps.select("doc_id", F.explode("keys").alias("key")).repartition("key")
    buckets = met.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    stars = met.join(buckets, "key").filter("doc_id > least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    families = connected_components(stars)
    families = written(families.unionByName(families.select(F.col("component").alias("node"), "component").distinct()), "families")

    sized = reps.join(families, F.col("doc_id") == F.col("node")).select("doc_id", "d1", "n_shingles", "keys", F.col("component").alias("family"))
    share = F.greatest(F.sum("n_shingles") / task_shingles, F.count("*") / task_docs)  # of what a task may hold
    large = sized.groupBy("family").agg(share.alias("all")).withColumn("chunks", F.ceil(2 * F.col("all")).cast("int"))
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    sized = sized.join(large, "family").withColumn("chunks", F.when(F.col("all") <= 1, 1).otherwise(F.col("chunks"))).withColumn("chunk", chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                n = t.hi - t.lo
                h, doc = _sets(t, shingle_words)
                first = np.searchsorted(doc, np.arange(n + 1))
                raw = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                rows = pa.RecordBatch.from_arrays([*(batch.column(k).slice(t.lo, n) for k in range(5)), pa.array(raw, pa.binary())], ["doc_id", "keys", "family", "chunk", "chunks", "elements"])
                yield rows.filter(pa.array(_sums(mix(h), first) == batch.column(5).to_numpy()[t.lo : t.hi]))

    columns = ["doc_id", "keys", "family", "chunk", "chunks", "d1"]
    full = base.join(sized.select(*columns), "doc_id").select(*columns, "text")
    full = full.mapInArrow(run, "doc_id long, keys array<long>, family long, chunk int, chunks int, elements binary")
    met_in = F.expr("transform(sequence(0, chunks - 1), c -> struct(least(c, chunk) as lo, greatest(c, chunk) as hi))")
    tasks = full.withColumn("task", F.explode(met_in)).select("family", "task.lo", "task.hi", "doc_id", "keys", "chunk", "elements")

    def verify(group: pa.Table) -> pa.Table:
        doc = group.column("doc_id").to_numpy()
        _, by = np.unique(doc, return_index=True)
        group = group.take(by)
        elements = group.column("elements").combine_chunks()
        sizes = pc.binary_length(elements).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        flat = np.frombuffer(b"".join(elements.to_pylist()), np.uint64)
        keys = pc.list_flatten(group.column("keys").combine_chunks()).to_numpy().reshape(len(by), -1)
        chunk = group.column("chunk").to_numpy()
        across = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        links = verified_links(doc[by], sizes, flat, keys, percent, chunk if across else None)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = tasks.groupBy("family", "lo", "hi").applyInArrow(verify, "a long, b long")
    joined = connected_components(links)
    return (
        table.join(classes, same, "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull()))
    )
