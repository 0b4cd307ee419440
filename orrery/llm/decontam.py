"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards and sorts each shard's word suffixes (prefix doubling; only
groups that are still tied are sorted again). The benchmark's suffixes are then searched in it by binary
search. A suffix can match no further than its first word that the shard lacks, so most end there.

What is found is a range of the suffix array for each window, and equal windows have one range, so the
places of all windows are at most the words of the shard for each size of window, however often text and
item repeat themselves. Words are hit by range. An item meets each place once, whichever of its windows lies
there; how far it matches from there is the common prefix with the item's neighbouring suffixes in the order
of both, so that no pair of a place and a suffix is looked at singly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Texts, texts, words, written

#: Benchmark text that one pass over the documents broadcasts at most; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
#: Pairs of a place and an item that are looked at together, but for those of one item in one document.
HELD_PAIRS = 2_000_000
MATCH = "struct<item_id: string, start: int, words: int, longest: int>"


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of s (small non-negative ints) in the order of their suffixes."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = s[sa[1:]] != s[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        i = sa[at]
        key = rank[i] * (n + 2) + rank[np.minimum(i + k, n)] + 1
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        sa[at] = i
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        rank[i] = np.maximum.accumulate(np.where(fresh, at, 0))
        k *= 2


def search(s: np.ndarray, sa: np.ndarray, q: np.ndarray, start: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix q[start:], the range of sa whose suffixes begin with its first `need` words."""
    n, padded = len(s), np.r_[s, -1]

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), n)
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, n - 1)
            at, right, equal = sa[mid], np.zeros(len(start), bool), np.ones(len(start), bool)
            for k in range(need.max(initial=0)):
                on = equal & (k < need)
                if not on.any():
                    break
                a, b = padded[np.minimum(at + k, n)], q[np.minimum(start + k, len(q) - 1)]
                right |= on & (a < b)
                equal &= ~on | (a == b)
            right |= equal if after else False
            open_ = lo < hi
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        return lo

    return bound(False), bound(True)


class TestWords:
    """Word hashes of benchmark items end to end, and for each suffix the words that a match needs."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw = [(t or "").encode() for _, t in items]
        w = words(Texts(0, len(raw), np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)), ALNUM)
        n = np.diff(w.first)
        self.ids = pa.array([str(i) for i, _ in items], pa.string())
        self.window = window
        self.hashes = w.hashes
        self.item = np.repeat(np.arange(len(items)), n)
        self.left = np.repeat(w.first[1:], n) - np.arange(len(w.hashes))
        self.need = np.minimum(window, np.repeat(n, n))


class Shard(NamedTuple):
    """Texts in words: of each text the index of its first word (one more entry than texts), the distinct hashes, the words as places in them from 1 with a 0 after each text, and the suffix array of that."""

    first: np.ndarray
    known: np.ndarray
    code: np.ndarray
    sa: np.ndarray


def sorted_shard(t: Texts, wanted: np.ndarray | None = None) -> Shard:
    """wanted: hashes that are asked for; suffixes are left unsorted (an empty array) if the texts hold none of them."""
    w = words(t, ALNUM)
    known, place = np.unique(w.hashes, return_inverse=True)
    code = np.insert(place.astype(np.int64) + 1, w.first[1:], 0)
    none = wanted is not None and not np.isin(known, wanted).any()
    return Shard(w.first, known, code, np.zeros(0, np.int64) if none else suffix_array(code))


class Prefixes:
    """Common prefixes of any two suffixes of a sequence that ends with a value of its own, by classes of substrings of 1, 2, 4, ... values."""

    def __init__(self, s: np.ndarray):
        self.levels = [np.unique(s, return_inverse=True)[1]]
        n, k = len(s), 1
        while self.levels[-1].max(initial=-1) + 1 < n:
            now = self.levels[-1]
            after = np.full(n, -1)
            after[:-k] = now[k:]
            self.levels.append(np.unique(now * (n + 1) + after, return_inverse=True)[1])
            k *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            same = self.levels[k][i] == self.levels[k][j]
            i[same] += 1 << k
            j[same] += 1 << k
            out[same] += 1 << k
        return out


class Reach:
    """How far an item matches from a place of a text: places and starts of items as sequences of windows, both in one suffix array."""

    def __init__(self, place: np.ndarray, place_window: np.ndarray, start: np.ndarray, start_window: np.ndarray, item: np.ndarray):
        self.place = place
        gap = np.ones(len(place) + len(start), bool)
        gap[1 : len(place)] = place[1:] != place[:-1] + 1
        gap[len(place) + 1 :] = (start[1:] != start[:-1] + 1) | (item[1:] != item[:-1])
        value = np.r_[place_window, start_window]
        at = np.arange(len(value)) + np.cumsum(gap) - 1  # a value of its own follows each run
        s = np.full(int(at[-1]) + 2, -1)
        s[at] = value
        alone = np.flatnonzero(s < 0)
        s[alone] = value.max() + 1 + np.arange(len(alone))
        self.prefixes = Prefixes(s)
        rank = np.empty(len(s), np.int64)
        rank[suffix_array(s)] = np.arange(len(s))
        self.n, self.place_at = len(s), at[: len(place)]
        self.place_rank = rank[self.place_at]
        key = item * self.n + rank[at[len(place) :]]
        by = np.argsort(key)
        self.key, self.start_at = key[by], at[len(place) :][by]

    def windows(self, place: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Consecutive windows of the item that match from each place."""
        k = np.searchsorted(self.place, place)
        i = self.place_at[k]
        after = np.searchsorted(self.key, item * self.n + self.place_rank[k])
        out = np.zeros(len(place), np.int64)
        for near in (after - 1, after):
            near = np.clip(near, 0, len(self.key) - 1)
            on = np.flatnonzero(self.key[near] // self.n == item)
            out[on] = np.maximum(out[on], self.prefixes.common(i[on], self.start_at[near[on]]))
        return out


class Matches(NamedTuple):
    """By text: words, words that are hit. By match, ordered by text: text, item, first word, words, words of the longest verbatim match."""

    n_words: np.ndarray
    n_hit: np.ndarray
    doc: np.ndarray
    item: np.ndarray
    start: np.ndarray
    words: np.ndarray
    longest: np.ndarray

    def lists(self, ids: pa.Array) -> pa.ListArray:
        parts = [ids.take(pa.array(self.item)), *(pa.array(x.astype(np.int32)) for x in (self.start, self.words, self.longest))]
        ends = np.searchsorted(self.doc, np.arange(len(self.n_words) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["item_id", "start", "words", "longest"]))


def _spread_out(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges [first, first + count): which range each member is of, and the member."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def shard_matches(shard: Shard, test: TestWords, held: int = HELD_PAIRS) -> Matches:
    """All matches of the test in a shard."""
    docs, n_words = len(shard.first) - 1, np.diff(shard.first)
    nothing = np.zeros(0, np.int64)
    none = Matches(n_words, np.zeros(docs, np.int64), *[nothing] * 5)
    if not len(shard.sa) or not len(shard.known) or not len(test.hashes):
        return none
    at = np.minimum(np.searchsorted(shard.known, test.hashes), len(shard.known) - 1)
    present = shard.known[at] == test.hashes
    gap = np.flatnonzero(np.r_[~present, True])
    run = gap[np.searchsorted(gap, np.arange(len(present)))] - np.arange(len(present))
    start = np.flatnonzero(np.minimum(run, test.left) >= test.need)
    lo, hi = search(shard.code, shard.sa, np.where(present, at + 1, 0), start, test.need[start])
    start, lo, hi = start[hi > lo], lo[hi > lo], hi[hi > lo]
    if not len(start):
        return none
    item, need = test.item[start], test.need[start]
    _, index, window = np.unique(lo * (test.window + 1) + need, return_index=True, return_inverse=True)
    size = need[index]
    which, place = _spread_out(lo[index], (hi - lo)[index])
    place = shard.sa[place]

    base = shard.first[:-1] + np.arange(docs)
    edge = np.zeros(len(shard.code) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size[which], -1)
    n_hit = np.diff(np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)][np.r_[base, len(shard.code)]])

    whole, whole_start = size[which] == test.window, need == test.window
    reach = None
    if whole.any():
        by = np.argsort(place[whole])
        reach = Reach(place[whole][by], which[whole][by], start[whole_start], window[whole_start], item[whole_start])
    of_window = np.unique(window * (len(test.ids) + 1) + item)  # a window meets each of its items once
    items_window, items_of = of_window // (len(test.ids) + 1), of_window % (len(test.ids) + 1)
    doc = np.searchsorted(base, place, "right") - 1
    by = np.argsort(doc, kind="stable")
    which, place, doc = which[by], place[by], doc[by]
    count = np.bincount(items_window, minlength=len(size))[which]
    made, parts = np.r_[0, np.cumsum(count)], []
    ends = np.r_[np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc)]
    a = 0
    while a < len(doc):  # whole documents, as many as give so many pairs; the items of a larger one in several turns
        b = int(ends[max(np.searchsorted(made[ends], made[a] + held, "right") - 1, np.searchsorted(ends, a, "right"))])
        turns = -(-int(made[b] - made[a]) // held)
        for turn in range(turns):
            mine = items_of % turns == turn
            first = np.searchsorted(items_window[mine], np.arange(len(size) + 1))
            o, k = _spread_out(first[which[a:b]], np.diff(first)[which[a:b]])
            parts.append(_spans(doc[a:b][o], items_of[mine][k], place[a:b][o], size[which[a:b]][o], test.window, reach))
        a = b
    doc, item, place, long, longest = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((place, item, doc))
    return Matches(n_words, n_hit, doc[by], item[by], (place - base[doc])[by], long[by], longest[by])


def _spans(doc: np.ndarray, item: np.ndarray, place: np.ndarray, size: np.ndarray, window: int, reach: Reach | None) -> tuple[np.ndarray, ...]:
    """Places where windows of items lie to runs of words that are inside: doc, item, first, words, longest."""
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    by = np.lexsort((place, item, doc))
    doc, item, place, size = doc[by], item[by], place[by], size[by]
    long = size.copy()
    whole = np.flatnonzero(size == window)
    if reach is not None and len(whole):
        long[whole] += np.maximum(reach.windows(place[whole], item[whole]), 1) - 1
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] > place[:-1] + size[:-1])
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(doc)] - 1
    return doc[begin], item[begin], place[begin], place[end] + size[end] - place[begin], np.maximum.reduceat(long, begin)


def _items(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> tuple[DataFrame, int]:
    """Items with a text, and how many passes they take."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-size // pass_bytes) or 1


def _block(items: DataFrame, k: int, passes: int, window: int):
    """The items of one pass, broadcast."""
    block = items if passes == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
    return items.sparkSession.sparkContext.broadcast(TestWords([(r.item_id, r.text) for r in block.collect()], window))


def _matched(rows: DataFrame, test) -> DataFrame:
    """rows(key, text) to key, n_words, n_hit, matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, limit=SHARD_BYTES):
                found = shard_matches(sorted_shard(t, test.value.hashes), test.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.lo, t.hi - t.lo), pa.array(found.n_words), pa.array(found.n_hit), found.lists(test.value.ids)], ["key", "n_words", "n_hit", "matches"])

    return rows.mapInArrow(run, f"key long, n_words long, n_hit long, matches array<{MATCH}>")


def _shards(rows: DataFrame) -> DataFrame:
    """rows(key, text) as sorted shards, a row each: keys of the texts, and a Shard's arrays as bytes."""
    narrow = (np.int64, np.uint64, np.int32, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, limit=SHARD_BYTES):
                parts = [x.astype(kind).tobytes() for x, kind in zip(sorted_shard(t), narrow)]
                keys = batch.column(0).slice(t.lo, t.hi - t.lo).to_numpy().astype(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (keys, *parts)], ["keys", *Shard._fields])

    return rows.mapInArrow(run, "keys binary, first binary, known binary, code binary, sa binary")


def _in_passes(rows: DataFrame, items: DataFrame, passes: int, window: int) -> DataFrame:
    """key, n_words, matches of rows(key, text) with a match. Shards are sorted once and written, and searched pass after pass: the driver and each task hold one pass's items at a time, and a pass's matches are written before the next begins."""
    shards, parts = written(_shards(rows), "shards"), []
    for k in range(passes):
        test = _block(items, k, passes, window)

        def run(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    keys = np.frombuffer(r["keys"], np.int64)
                    shard = Shard(*(np.frombuffer(r[f], kind).astype(wide) for f, kind, wide in zip(Shard._fields, (np.int64, np.uint64, np.int32, np.int32), (np.int64, np.uint64, np.int64, np.int64))))
                    found = shard_matches(shard, test.value)
                    out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found.n_words), found.lists(test.value.ids)], ["key", "n_words", "matches"])
                    yield out.filter(pa.array(found.n_hit > 0))

        parts.append(written(shards.mapInArrow(run, f"key long, n_words long, matches array<{MATCH}>"), "matches"))
        test.unpersist()
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))


def _word_counts(rows: DataFrame) -> DataFrame:
    """rows(key, doc_id, text) to key, doc_id, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, limit=SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(t.lo, t.hi - t.lo) for k in (0, 1)), pa.array(np.diff(words(t, ALNUM).first))], ["key", "doc_id", "n_words"])

    return rows.mapInArrow(run, "key long, doc_id long, n_words long")


def _hit() -> Column:
    """Words inside matches, which may overlap."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    in_order = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["words"]).alias("end"))))
    hit = F.aggregate(in_order, zero, lambda a, m: F.struct(F.greatest(a["end"], m["end"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), m["end"] - F.greatest(a["end"], m["start"]))).alias("hit")), lambda a: a["hit"])
    return F.when(F.size("matches") > 0, hit).otherwise(F.lit(0).cast("long"))


def longest_matches(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, matches (item_id, first word and number of every run of words that windows of the item cover, and the words of the longest verbatim match that begins in it).

    Words are runs of digits, letters a to z (A-Z lower-cased) and characters outside ASCII. An item of fewer
    words than a window, but not none, is one window. Null texts have no words; an empty benchmark matches
    nothing; rows that repeat an id, or have none, get a row each, whatever the number of passes; other columns
    are ignored; an empty table gives no rows. Memory is bounded by a shard's words (a longer text is a shard of its
    own), however repetitive texts and items are. Words are compared by 64-bit hashes.
    """
    base = documents.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    items, passes = _items(benchmark, item_col, item_text_col, pass_bytes)
    if passes == 1:
        found = _matched(base, _block(items, 0, 1, window)).withColumnRenamed("key", "doc_id")
    else:
        rows = written(base.withColumnRenamed("key", "doc_id").withColumn("key", F.monotonically_increasing_id()), "numbered")
        met = _in_passes(rows.select("key", "text"), items, passes, window).select("key", _hit().alias("hit"), F.col("matches").alias("met"))
        found = _word_counts(rows.select("key", "doc_id", "text")).join(met, "key", "left").drop("key")
        found = found.withColumn("n_hit", F.coalesce("hit", F.lit(0).cast("long"))).withColumn("matches", F.coalesce("met", F.array().cast(f"array<{MATCH}>")))
    return found.select("doc_id", "n_words", "n_hit", "matches")


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """At least a twentieth of the words lies in matches."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, pass_bytes: int = PASS_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, every column kept, without those that are contaminated. Each row is judged by its own text, whatever its id and the names of its columns; null and empty texts stay."""
    items, passes = _items(benchmark, item_col, item_text_col, pass_bytes)
    if passes > 1:
        key = f"row_{uuid.uuid4().hex}"
        rows = written(documents.withColumn(key, F.monotonically_increasing_id()), "numbered")
        found = _in_passes(rows.select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")), items, passes, window)
        bad = found.withColumn("n_hit", _hit()).filter(contaminated()).select(F.col("key").alias(key))
        return rows.join(bad, key, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
    test = _block(items, 0, 1, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch, text_col, limit=SHARD_BYTES):
                found = shard_matches(sorted_shard(t, test.value.hashes), test.value)
                yield batch.slice(t.lo, t.hi - t.lo).filter(pa.array((found.n_hit == 0) | (20 * found.n_hit < found.n_words)))

    return documents.mapInArrow(run, documents.schema)
