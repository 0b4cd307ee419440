"""Importance resampling towards a target: documents are drawn with odds by hashed word n-grams, without replacement.

The texts of a batch are joined with a separator that no word holds, one pass of a regular expression finds
all words, and the documents' offsets tell whose each word is, so that n-grams across documents are masked
out before anything is counted. Buckets are CRC-32 of an n-gram, computed for all words of a batch at once,
byte by byte; an n-gram goes on from where the n-gram without its last word stopped.

Two passes over the documents: one counts buckets, a few thousand sums that a task passes on once; one
scores. Ranks come from a histogram of scores and an order within each score, so no task orders all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Texts, spread, texts, written

#: Digits, letters a to z and everything outside ASCII, in UTF-8; texts are lower-cased before.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SEPARATOR = b"\n"
BUCKETS = 10_000
#: Bytes of a word that are hashed side by side with other words'; longer words are hashed one by one.
SIDE_BY_SIDE = 48
#: Scores of one coarse bin of the histogram.
COARSE = 256


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)


def _extended(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of each range. A state is the checksum with all bits turned."""
    size = ends - starts
    by = np.argsort(-np.minimum(size, SIDE_BY_SIDE + 1).astype(np.int8), kind="stable")
    out, at = state[by], starts[by]
    lengths = size[by]
    long = int(np.searchsorted(-lengths, -SIDE_BY_SIDE, "left"))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + lengths[i]], int(out[i] ^ _FULL)) ^ 0xFFFFFFFF
    for k in range(int(lengths[long]) if long < len(lengths) else 0):
        on = slice(long, int(np.searchsorted(-lengths, -k, "left")))
        now = out[on]
        out[on] = CRC[(now ^ data[at[on] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[by] = out
    return back


def features(t: Texts, n: int = 2, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to n words in turn: the document and the bucket of each."""
    raw = t.data.tobytes()
    cuts = t.offsets.tolist()
    joined = SEPARATOR.join(raw[a:b] for a, b in zip(cuts, cuts[1:])).lower()
    found = np.fromiter(chain.from_iterable(map(re.Match.span, WORD.finditer(joined))), np.int64).reshape(-1, 2)
    starts, ends = found[:, 0], found[:, 1]
    doc = np.searchsorted(t.offsets[1:] + np.arange(1, len(t.offsets)), starts, "right")
    data = np.frombuffer(joined, np.uint8)
    state, at = np.full(len(starts), _FULL), np.arange(len(starts))
    for k in range(n):
        if k:
            inside = np.flatnonzero(doc[k:] == doc[: len(doc) - k])  # the rest lie across documents
            state = state[np.searchsorted(at, inside)]
            state = CRC[(state ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
            at = inside
        state = _extended(state, data, starts[at + k], ends[at + k])
        yield doc[at], ((state ^ _FULL) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(rows: DataFrame, n: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts of rows(text). The driver gets one sum per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in texts(batch):
                for _, bucket in features(t, n, buckets):
                    seen += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in spread(rows).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, with one added to every count."""
    over = (target + 1).astype(np.float64) * float(raw.sum() + len(raw))
    under = (raw + 1).astype(np.float64) * float(target.sum() + len(target))
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def weights(rows: DataFrame, gain: np.ndarray, n: int = 2) -> DataFrame:
    """rows(doc_id, text) to doc_id, n_words, n_features, weight: the mean gain of a text's features, rounded down; 0 without any."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for t in texts(batch):
                docs = t.hi - t.lo
                count, total, n_words = np.zeros(docs, np.int64), np.zeros(docs, np.int64), None
                for doc, bucket in features(t, n, len(gain)):
                    of_doc = np.bincount(doc, minlength=docs)
                    n_words = of_doc if n_words is None else n_words
                    count += of_doc
                    total += np.bincount(doc, gain[bucket], docs).astype(np.int64)  # whole numbers far below 2^53
                weight = total // np.maximum(count, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, docs), pa.array(n_words), pa.array(count), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return spread(rows).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, *, n: int = 2, buckets: int = BUCKETS, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (from 1 by falling score, ties to the smaller id; null if not drawn).

    Words are runs of digits, letters (A-Z lower-cased) and characters outside ASCII; features all runs of 1 to n
    of them. score is the weight plus Gumbel noise by the id, in thousandths, so the best are a draw without
    replacement. Of the N documents with least_words words or more, floor(percent * N / 100) are drawn. Null and
    empty texts have no features and weight 0. Rows without an id have no score and are never drawn nor counted
    in N; rows that repeat one are scored each by its own text. Other columns are ignored; without any target
    text rare buckets weigh more than common ones; an empty table gives no rows.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(rows.select("text"), n, buckets), bucket_counts(target.select(F.col(target_text_col).cast("string").alias("text")), n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = written(weights(rows, gain, n).withColumn("score", F.col("weight") + noise), "scored")

    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    counted = scored.filter(may).groupBy("score").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("score") / COARSE))
    counted = written(counted, "histogram")  # thousandths of a bounded number: some ten thousand rows, however many documents
    best_first = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(best_first), F.lit(0))).drop("n")  # some hundred rows
    within = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    better = counted.join(F.broadcast(bins), "bin").select("score", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))
    drawn = percent * (counted.agg(F.sum("n")).first()[0] or 0) // 100
    better = F.broadcast(better.filter(F.col("before") < drawn).withColumnRenamed("score", "_score"))

    met = scored.join(better, may & (F.col("score") == F.col("_score")), "left")
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    rank = F.col("before") + F.row_number().over(order)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    near = met.filter("before is not null").withColumn("rank", rank).select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return met.filter("before is null").select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(near)


def drawn(documents: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, every column kept. All rows of an id are kept if one of them is drawn."""
    picked = resample(documents, target, id_col=id_col, **options).filter("rank is not null").select("doc_id").distinct()
    key = "_drawn_id"
    return documents.join(picked.withColumnRenamed("doc_id", key), F.col(f"`{id_col}`").cast("long") == F.col(key), "left_semi")
