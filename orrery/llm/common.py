"""What the corpus operators share: shared-folder tables, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240917)
BYTE_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are not white space: words of the near-duplicate operator.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and everything outside ASCII: words of the decontamination operator.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. In local mode, where driver and tasks are one process, a temporary one is set if it is unset; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer files than there are cores, for costly work on every row; select what is needed first.

    A table in more files is left as it is, so that a large one isn't shuffled. The rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


#: Keys with this share of all rows are hot; there can't be more of them than that.
HOT = 1000


def by_class(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows, each with the columns of its class. classes hold every key once (null may be one) and n, the rows of it.

    Keys that hold a thousandth of all rows or more, a thousand at most, are broadcast; the others are joined by
    shuffle, where none is hot. rows and classes are written tables.
    """
    one = f"class_{uuid.uuid4().hex}"
    named = classes.withColumnRenamed(key, one)
    total = named.agg(F.sum("n")).first()[0] or 0
    hot, cold = named.filter(F.col("n") * HOT >= total), named.filter(F.col("n") * HOT < total)
    same = F.col(key).eqNullSafe(F.col(one))
    rest = rows.join(F.broadcast(hot.select(one)), same, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(rest.join(cold, same)).drop(one, "n")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for root in roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Texts(NamedTuple):
    """Rows lo..hi of a batch: their bytes end to end, and where each begins (one more entry than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def texts(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole rows of at most `limit` bytes each (a longer text is a run of its own). Null reads as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(col))
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in a new array."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n + 1:
        m = max(n + 1, CHUNK_BYTES + 65536)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.r_[_U(1), np.full(m - 1, b, np.uint64)]) for b in (_BASE, _BASE_INV))
    return _powers


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a text's end always ends a run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = np.empty(n + 1, bool)
    edge[0] = inside[0]
    edge[n] = inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    first = inside & (edge[:-1] | cut[:-1])
    last = inside & (edge[1:] | cut[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    power, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text: index of its first word; one more entry than texts


def words(t: Texts, is_word: np.ndarray) -> Words:
    """Words of every text, A-Z lower-cased."""
    low = LOWER[t.data]
    starts, ends = spans(is_word[low], t.offsets)
    return Words(starts, ends, hashed(low, starts, ends), np.searchsorted(starts, t.offsets))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every text and the text of each. A text of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(w.first)
    code = _powers_to(size + 64)[0]
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.first[:-1], count)
    h = np.zeros(len(at), np.uint64)
    have = np.repeat(np.minimum(n, size), count)
    for k in range(size):
        inside = have > k
        h += np.where(inside, w.hashes[np.minimum(at + k, max(len(w.hashes) - 1, 0))] if len(w.hashes) else _U(0), _U(0)) * code[2 * k + 3]
    return mix(h + have.astype(np.uint64)), doc
