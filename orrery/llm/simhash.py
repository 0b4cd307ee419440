"""Near duplicates by SimHash, found by meet-in-the-middle ball hashing.

Fingerprints that differ in at most 2r bits have a word in common that differs from each in r bits at most.
So every fingerprint emits all its variants within r bits, and those that emit the same variant meet. All
that meet in a variant are within 2r bits of each other, so each is linked to the least of them, and links
are deduplicated and verified; no group gives all its pairs.

Variants aren't shuffled one by one. A fingerprint goes once to each prefix that its variants begin with (137
of 16 bits, instead of 2081 variants), and the task that gets a prefix makes the variants of that prefix,
sorts them and finds those that meet. A prefix that more fingerprints go to than a task should hold is
divided by 8 further bits, and so on; with all 64 bits no more than 2081 fingerprints can go to a variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Texts, by_class, spans, spread, texts, written
from .components import connected_components

SEED = 42
RADIUS = 4
PREFIX_BITS = 16
#: Fingerprints that may go to one prefix before it is divided.
MOST = 10_000
#: Variants that a task holds at a time, but for those of one prefix.
HELD = 4_000_000
#: Hashes whose bits are counted at a time.
SLICE = 1 << 17


def shingle_hashes(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, repeats included, and of each text the index of its first; one more entry than texts."""
    low = LOWER[t.data]
    starts, ends = spans(NOT_SPACE[low], t.offsets)
    first = np.searchsorted(starts, t.offsets)
    length = ends - starts
    place = np.r_[0, np.cumsum(length + 1)]  # of each word among all words, joined by one blank
    flat = np.full(place[-1], 32, np.uint8)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(place[:-1], length) + within] = low[np.repeat(starts, length) + within]
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.r_[0, np.cumsum(count)]
    a = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    b = a + np.repeat(np.minimum(n, size), count) - 1
    raw, digest = flat.tobytes(), xxhash.xxh64_intdigest
    if not len(a):
        return np.zeros(0, np.uint64), begin
    lo, hi = place[a].tolist(), (place[b] + length[b]).tolist()
    return np.fromiter((digest(raw[x:y], SEED) for x, y in zip(lo, hi)), np.uint64, len(lo)), begin


def fingerprint(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each text the bits that are set in over half its hashes."""
    docs = len(begin) - 1
    ones = np.zeros((docs, 64), np.int64)
    doc = np.repeat(np.arange(docs), np.diff(begin))
    for a in range(0, len(h), SLICE):
        bits = np.unpackbits(h[a : a + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at, of = np.unique(doc[a : a + SLICE], return_index=True)
        ones[at] += np.add.reduceat(bits, of, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > np.diff(begin)[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(documents: DataFrame, *, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row. Null and blank texts have fingerprint 0; a text of fewer words than a shingle is one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch):
                fp = fingerprint(*shingle_hashes(t, shingle_words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, most: int) -> list[int]:
    """All words of so many bits with at most `most` ones, fewest ones first."""
    return [sum(1 << i for i in c) for k in range(min(most, bits) + 1) for c in combinations(range(bits), k)]


def messages(fps: DataFrame, bits: int, half: int) -> DataFrame:
    """(prefix, fp): every fingerprint for each prefix of so many bits that one of its variants begins with."""
    head = F.shiftrightunsigned(F.col("fp"), 64 - bits) if bits < 64 else F.col("fp")
    flips = F.array(*(F.lit(m if m < 2**63 else m - 2**64) for m in ball(bits, half)))
    return fps.select("fp", F.explode(flips).alias("flip")).select(head.bitwiseXOR(F.col("flip")).alias("prefix"), "fp")


def met(prefix: np.ndarray, fp: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that meet in a variant, each to the least of its variant, once."""
    low = 64 - bits
    head, tail = (fp >> np.uint64(low), fp & np.uint64((1 << low) - 1)) if low else (fp, np.zeros_like(fp))
    left = half - np.bitwise_count(prefix ^ head).astype(np.int64)
    variants, who = [], []
    for k in range(half + 1):
        on = np.flatnonzero(left == k)
        flips = np.array(ball(low, k), np.uint64)
        top = (prefix[on] << np.uint64(low)) if low else prefix[on]
        variants.append(((top | tail[on])[:, None] ^ flips[None, :]).ravel())
        who.append(np.repeat(fp[on], len(flips)))
    v, who = np.concatenate(variants), np.concatenate(who)
    by = np.argsort(v)
    v, who = v[by], who[by]
    new = np.r_[True, v[1:] != v[:-1]]
    many = ~(new & np.r_[new[1:], True])
    v, who, new = v[many], who[many], new[many]
    if not len(v):
        return who, who
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.r_[starts, len(v)]))
    on = (who != least) & (np.bitwise_count(who ^ least) <= 2 * half)
    pairs = np.unique(np.stack([who[on], least[on]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _met_in_tasks(sent: DataFrame, bits: int, half: int, held: int) -> DataFrame:
    cost = np.array([len(ball(64 - bits, k)) for k in range(half + 1)])

    def links(prefix: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole prefixes, as many at a time as there are variants to hold."""
        if not len(prefix):
            return
        head = fp >> np.uint64(64 - bits) if bits < 64 else fp
        made = np.cumsum(cost[half - np.bitwise_count(prefix ^ head).astype(np.int64)])
        ends = np.r_[np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, len(prefix)]
        a, done = 0, 0
        while a < len(prefix):
            k = max(np.searchsorted(made[ends - 1], done + held, "right") - 1, np.searchsorted(ends, a, "right"))
            b = int(ends[k])
            x, y = met(prefix[a:b], fp[a:b], bits, half)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
            a, done = b, int(made[b - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = fp = np.zeros(0, np.uint64)
        for batch in batches:
            prefix = np.r_[prefix, batch.column(0).to_numpy().view(np.uint64)]
            fp = np.r_[fp, batch.column(1).to_numpy().view(np.uint64)]
            if len(prefix):
                cut = len(prefix) - int(np.argmax(prefix[::-1] != prefix[-1])) if prefix[0] != prefix[-1] else 0  # where the last prefix begins
                yield from links(prefix[:cut], fp[:cut])
                prefix, fp = prefix[cut:], fp[cut:]
        yield from links(prefix, fp)

    return sent.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, *, radius: int = RADIUS, prefix_bits: int = PREFIX_BITS, most: int = MOST, held: int = HELD) -> DataFrame:
    """(a, b): links that connect what differs in at most `radius` bits, between distinct fingerprints of fps(fp)."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius is an even number of bits")
    half = radius // 2
    most = max(most, len(ball(64, half)))
    parts, bits, crowded = [], prefix_bits, None
    while True:
        sent = messages(fps, bits, half)
        if crowded is not None:
            above = crowded.select(F.col("prefix").alias("above"))
            sent = sent.join(above, F.shiftrightunsigned("prefix", bits - before) == F.col("above"), "left_semi")
        crowded = written(sent.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("prefix"), "crowded")
        if crowded.isEmpty():
            parts.append(_met_in_tasks(sent, bits, half, held))
            return reduce(DataFrame.unionByName, parts).distinct()
        parts.append(_met_in_tasks(sent.join(crowded, "prefix", "left_anti"), bits, half, held))
        before, bits = bits, min(64, bits + 8)


def near_duplicates(documents: DataFrame, *, shingle_words: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least id reachable over links of fingerprints that differ in at most `radius` bits).

    Words are parted by white space, A-Z lower-cased; a bit is set if it is set in over half the hashes of a text's
    shingles, repeats included. Texts of fewer words than a shingle are one shingle; null and blank texts have
    fingerprint 0 and are linked as any other. Rows that repeat an id, or have none, are judged each by its own
    text; a component without any id has none. Other columns are ignored; an empty table gives no rows.
    """
    table = written(fingerprints(documents, shingle_words=shingle_words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = written(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    joined = connected_components(links(classes.select("fp"), radius=radius, **options))
    joined = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())  # the least of a component is a node, too
    linked = written(classes.join(joined, F.col("fp") == F.col("node")).select("fp", "least", "component"), "linked")
    roots = written(linked.groupBy("component").agg(F.min("least").alias("root"), F.count("*").alias("n")), "roots")
    found = by_class(linked, roots, "component").select("fp", "root")
    classes = written(classes.join(found, "fp", "left").select("fp", "n", F.coalesce("root", "least").alias("component_id")), "classes")
    out = by_class(table, classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
