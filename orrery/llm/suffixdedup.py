"""Removal of passages that repeat across documents, by difference-cover suffix sorting.

Sorting every suffix of a corpus by itself would move each byte many times over. Here only text that can
repeat is sorted, and it is dealt out so that suffixes that could be equal always meet:

0. A document whose whole text a smaller one has is settled by a digest and takes no further part.
1. A window of 50 bytes is represented by the least hashed 28-gram in it, so equal windows have equal
   representatives at equal offsets. Tasks list the distinct representatives of each block of documents,
   and those seen in one document only are dropped; no repeated window is lost.
   The lists meet by group of representatives; those of a large corpus are merged by chunk of blocks first, so
   no task holds an entry per block of the corpus, however common a representative is.
2. What is left of each block is cut into contexts, the runs of windows of one representative. Copies
   within the block are resolved there; each distinct context goes to the bucket of its representative.
   Contexts of one that very many blocks hold are split, by the side on which their windows reach 11 bytes
   beyond it at least, and go by those bytes too.
3. Contexts that agree with no other document for 11 bytes beyond the representative on either side go. The rest of each bucket is suffix-sorted, in pieces, by the
   difference-cover algorithm modulo 3 (sort sampled triples, recurse on their names, merge the remaining
   suffixes), and neighbours whose first 50 bytes are equal share the least document they occur in.
4. Windows that a smaller document also has go back to their blocks, where they are joined to spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODE, Texts, hashed, mix, spans, texts, written

LENGTH, GRAM = 50, 28
BLOCK_BYTES = 4 << 20
#: Text that is looked at together in a block, text per bucket of a shuffle, and suffix sorts per bucket.
STEP_BYTES, BUCKET_BYTES, PIECES = 1 << 20, 16 << 20, 64
#: Contexts of representatives that more blocks hold than this are dealt by longer keys.
HOT_BLOCKS = 64
#: A window reaches so many bytes beyond its representative on one side at least.
HALF = (LENGTH - GRAM) // 2
#: Groups that representatives are listed in. A larger corpus has chunks of blocks instead of more groups, so that a block's rows stay as they are.
GROUPS = 512
#: Partitions of a shuffle at most; beyond, each takes several buckets one after the other.
MOST_PARTS = 50_000
#: The id that rows without one have: less than all others.
NO_ID = -(2**63)
_U = np.uint64


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """The difference-cover algorithm modulo 3; s holds integers from 1 to top."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    p = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])

    def pairs(first: np.ndarray, second: np.ndarray, most: int) -> tuple[np.ndarray, int]:
        key = first * (most + 1) + second
        return key, (top + 1) * (most + 1)

    # sampled positions: those that aren't 0 modulo 3, with one past the end if that would be 1
    at = np.arange(n + (n % 3 == 1))
    one, two = at[at % 3 == 1], at[at % 3 == 2]
    sample = np.concatenate([one, two])
    key, most = pairs(p[sample], p[sample + 1], top)
    if most * (top + 1) >= 2**62:
        key, most = np.unique(key, return_inverse=True)[1], len(key)
    key = key * (top + 1) + p[sample + 2]
    by = np.argsort(key)
    new = np.ones(len(by), bool)
    new[1:] = key[by[1:]] != key[by[:-1]]
    name = np.empty(len(by), np.int64)
    name[by] = np.cumsum(new)
    if not new.all():
        by = suffix_array(name, int(name.max()))
    order = sample[by]
    m = len(order)
    rank = np.zeros(n + 4, np.int64)
    rank[order] = np.arange(1, m + 1)
    # the remaining suffixes: by their first symbol, then by the sampled suffix behind it
    zero = order[order % 3 == 1] - 1
    zero = zero[np.argsort(p[zero] * (m + 2) + rank[zero + 1])]
    ones, twos = order[order % 3 == 1], order[order % 3 == 2]
    before = np.searchsorted(p[ones] * (m + 2) + rank[ones + 1], p[zero] * (m + 2) + rank[zero + 1])
    both = np.concatenate([zero, twos])
    key = p[both] * (top + 1) + p[both + 1]
    if (top + 1) * (top + 1) * (m + 2) >= 2**62:
        key = np.unique(key, return_inverse=True)[1]
    key = key * (m + 2) + rank[both + 2]
    before += np.searchsorted(key[len(zero) :], key[: len(zero)])
    out = np.full(m + len(zero), -1, np.int64)
    out[before + np.arange(len(zero))] = zero
    out[out < 0] = order
    return out[out < n]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x += b
    return x


def contexts(data: np.ndarray, offsets: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the live documents with one representative: first window, how many, how far in the representative begins, its hash."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h = BYTE_CODE[data]
    for k in (1, 2):
        h = _join(h[:-k], h[k:])
    four = h
    h = eight = _join(h[:-4], h[4:])
    h = _join(h[:-8], h[8:])
    h = _join(_join(h[:-8], eight[16:])[:-4], four[24:])
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(31)
    bits = _U(max(24, n.bit_length()))
    low = (_U(1) << bits) - _U(1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8):
        best = np.minimum(best[:-k], best[k:])
    rest = LENGTH - GRAM + 1 - 16
    best = np.minimum(best[:-rest], best[rest:])
    at = (best & low).astype(np.int64)
    full = live & (np.diff(offsets) >= LENGTH)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, offsets[1:][full] - LENGTH + 1, -1)
    inside = np.cumsum(edge)[: len(at)] > 0
    start = inside.copy()
    start[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    end = inside.copy()
    end[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1 - first, at[first] - first, mix(h[at[first]])


def _steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most STEP_BYTES (or one)."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


#: A key is 48 bits of a representative's hash; other bits choose its group. The lowest bit is a flag.
_KEY = _U((1 << 48) - 2)


def _keyed(h: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> _U(15)) & _KEY, ((mix(h) >> _U(20)) % _U(groups)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys, byte plane by byte plane."""
    return _zip(np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(raw), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start, start+1, ... start+size-1, range after range."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of intervals [a, b) as int32 pairs."""
    if not len(a):
        return np.zeros((0, 2), np.int32)
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    new = np.r_[True, a[1:] > b[:-1]]
    return np.stack([a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]], 1).astype(np.int32)


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value begins in arrays that are sorted together."""
    n = len(sorted_by[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _joined(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed frame: their sizes in bytes, then their bytes."""
    raw = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return _zip(np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw))


def _parted(frame: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = _unzip(frame)
    sizes = np.frombuffer(raw, "<i8", len(kinds))
    ends = 8 * len(kinds) + np.cumsum(sizes)
    return [np.frombuffer(raw, k, n // np.dtype(k).itemsize, e - n) for k, n, e in zip(kinds, sizes, ends)]


def blocks(documents: DataFrame) -> DataFrame:
    """Documents put together: block, docs (their ids), sizes and digests, data (their texts), rest (every further column and whether the text is null, row by row); data and rest are compressed.

    The first two columns of documents are the id and the text.
    """
    more = len(documents.columns) > 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def done() -> pa.RecordBatch:
            docs, sizes, raw = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), b"".join(x[2] for x in held)
            rest = None
            if more:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held[0][4].schema) as w:
                    for x in held:
                        w.write_batch(x[4])
                rest = _zip(sink.getvalue().to_pybytes())
            lists = [pa.array([x], pa.list_(t)) for x, t in ((docs.to_pylist(), pa.int64()), (sizes.tolist(), pa.int64()), ([d for x in held for d in x[3]], pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([part + k]), *lists, pa.array([len(raw)]), pa.array([_zip(raw)], pa.binary()), pa.array([rest], pa.binary())], ["block", "docs", "sizes", "digests", "bytes", "data", "rest"])

        for batch in batches:
            rest = pa.RecordBatch.from_arrays([pc.is_null(batch.column(1)), *batch.columns[2:]], ["null", *(f"c{i}" for i in range(2, batch.num_columns))])
            for t in texts(batch, batch.schema.names[1], limit=BLOCK_BYTES // 4):
                if held and size + len(t.data) > BLOCK_BYTES:
                    yield done()
                    held, size, k = [], 0, k + 1
                raw = t.data.tobytes()
                held.append((batch.column(0).slice(t.lo, t.hi - t.lo), np.diff(t.offsets), raw, [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(t.offsets[:-1], t.offsets[1:])], rest.slice(t.lo, t.hi - t.lo)))
                size += len(t.data)
        if held:
            yield done()

    return documents.mapInArrow(run, "block long, docs array<long>, sizes array<long>, digests array<binary>, bytes long, data binary, rest binary")


def _opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and bytes of a block's documents."""
    docs = np.array([NO_ID if d is None else d for d in r["docs"]], np.int64)
    return docs, np.r_[0, np.cumsum(np.array(r["sizes"], np.int64))], np.frombuffer(_unzip(r["data"]), np.uint8)


#: Parts that the copies of one text are spread over.
SALTS = 8


def copies(table: DataFrame) -> DataFrame:
    """(block, copies): places in each block of documents whose whole text, of 50 bytes at least, a smaller document has."""
    each = table.select("block", F.posexplode(F.arrays_zip("docs", "sizes", "digests")).alias("place", "d"))
    each = each.select("block", "place", F.coalesce("d.docs", F.lit(NO_ID)).alias("id"), "d.digests", "d.sizes").filter(F.col("sizes") >= LENGTH)
    least = each.groupBy("digests", "sizes").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("digests", "sizes", "least")
    # a text's copies may be a third of all rows: they meet its least id in several tasks
    salted = each.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    found = salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digests", "sizes", "salt"]).filter("id > least")
    return found.groupBy("block").agg(F.collect_list("place").alias("copies"))  # at most a block's documents


def _live(docs: np.ndarray, right: pa.Table) -> np.ndarray:
    """Documents of a block that aren't copies."""
    out = np.ones(len(docs), bool)
    for places in right.column("copies").to_pylist():
        out[places or []] = False
    return out


_LISTED = "grp int, chunk int, block long, keys binary"


def _listed(**columns) -> pa.Table:
    kinds = {"grp": pa.int32(), "chunk": pa.int32(), "sub": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in columns.items()})


def representatives(table: DataFrame, same: DataFrame, groups: int, chunks: int, parts: int) -> DataFrame:
    """(grp, chunk, block, keys): a block's distinct representatives; the flag tells that several of its documents have it. No rows for a block of short texts or copies."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"grp": [], "chunk": [], "block": [], "keys": []}
        for r in left.to_pylist():
            docs, offsets, data = _opened(r)
            live, found = _live(docs, right), []
            for lo, hi in _steps(offsets):
                base = offsets[lo]
                first, _, _, h = contexts(data[base : offsets[hi]], offsets[lo : hi + 1] - base, live[lo:hi])
                found.append((*_keyed(h, groups), np.searchsorted(offsets, first + base, "right")))
            key, group, doc = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((doc, key, group))
            key, group, doc = key[by], group[by], doc[by]
            new = _starts(key, group)
            last = np.r_[new[1:], len(key)][: len(new)] - 1
            key, group = key[new] | (doc[new] != doc[last]).astype(np.uint64), group[new]
            cut = _starts(group)
            chunk = int(mix(np.array([r["block"]], np.uint64))[0] % _U(chunks))
            for a, b in zip(cut, np.r_[cut[1:], len(key)]):
                for n, v in zip(out, (int(group[a]), chunk, r["block"], _pack(key[a:b]))):
                    out[n].append(v)
        return _listed(**out)

    left = table.select("block", "docs", "sizes", "data").repartition(parts, "block")
    return left.groupBy("block").cogroup(same.groupBy("block")).applyInArrow(run, _LISTED)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of several lists without their flags, in how many blocks each is (counts: of each list's keys), and whether several documents have it."""
    key = np.concatenate(keys)
    n = np.ones(len(key), np.int64) if counts is None else np.concatenate(counts).astype(np.int64)
    by = np.argsort(key & ~_U(1), kind="stable")
    key, n = key[by], n[by]
    new = _starts(key & ~_U(1))
    if not len(new):
        return key, n, np.zeros(0, bool)
    blocks_ = np.add.reduceat(n, new)
    return key[new] & ~_U(1), blocks_, (blocks_ > 1) | (np.bitwise_or.reduceat(key, new) & _U(1) > 0)


def _picked(sought: np.ndarray, group: pa.Table) -> pa.Table:
    """(block, grp, keys): what the rows of a group have of the sorted keys that are sought, with their flags."""
    out = {"block": [], "grp": [], "keys": []}
    for block, g, raw in zip(*(group.column(n).to_pylist() for n in ("block", "grp", "keys"))):
        key = _unpack(raw) & ~_U(1)
        at = np.minimum(np.searchsorted(sought & ~_U(1), key), max(len(sought) - 1, 0))
        hit = (sought[at] & ~_U(1)) == key if len(sought) else np.zeros(len(key), bool)
        if hit.any():
            for n, v in zip(out, (block, g, _pack(sought[at[hit]]))):
                out[n].append(v)
    return _listed(**out)


def repeated(listed: DataFrame, hot_blocks: int, chunks: int, parts: int) -> DataFrame:
    """(block, grp, keys): of each block's representatives those that several documents have; the flag tells hot ones.

    With several chunks a group's lists are merged chunk by chunk, and only one entry of each chunk meets the others'.
    """
    kind = "block long, grp int, keys binary"

    def chosen(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> np.ndarray:
        key, n, several = _merged(keys, counts)
        return key[several] | (n[several] > hot_blocks).astype(np.uint64)

    if chunks == 1:
        return listed.repartition(parts, "grp").groupBy("grp").applyInArrow(lambda group: _picked(chosen([_unpack(x) for x in group.column("keys").to_pylist()]), group), kind)

    def merge(group: pa.Table) -> pa.Table:
        key, n, several = _merged([_unpack(x) for x in group.column("keys").to_pylist()])
        sub = ((key >> _U(1)) % _U(chunks)).astype(np.int64)
        by = np.lexsort((key, sub))
        key, n, sub = key[by] | several[by].astype(np.uint64), n[by], sub[by]
        cut = _starts(sub)
        end = np.r_[cut[1:], len(sub)]
        own = [group.column(c)[0].as_py() for c in ("grp", "chunk")]
        return _listed(grp=[own[0]] * len(cut), sub=sub[cut], chunk=[own[1]] * len(cut), keys=[_pack(key[a:b]) for a, b in zip(cut, end)], counts=[_zip(n[a:b].astype("<u4").tobytes()) for a, b in zip(cut, end)])

    def decide(group: pa.Table) -> pa.Table:
        keys = [_unpack(x) for x in group.column("keys").to_pylist()]
        keep = chosen(keys, [np.frombuffer(_unzip(x), "<u4") for x in group.column("counts").to_pylist()])
        own = pa.table({"block": group.column("chunk"), "grp": group.column("grp"), "keys": group.column("keys")})
        return _picked(keep, own).rename_columns(["chunk", "grp", "keys"]).select(["grp", "chunk", "keys"])

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        return _picked(np.sort(np.concatenate([np.zeros(0, np.uint64), *(_unpack(x) for x in right.column("keys").to_pylist())])), left)

    met = listed.repartition(parts, "grp", "chunk")
    merged = met.groupBy("grp", "chunk").applyInArrow(merge, "grp int, sub int, chunk int, keys binary, counts binary")
    decided = merged.repartition(parts, "grp", "sub").groupBy("grp", "sub").applyInArrow(decide, "grp int, chunk long, keys binary").select("grp", F.col("chunk").cast("int").alias("chunk"), "keys")
    return met.groupBy("grp", "chunk").cogroup(decided.groupBy("grp", "chunk")).applyInArrow(pick, kind)


_SENT = "bucket long, block long, frame binary, local binary"
#: Of a frame: contexts of each piece, documents, windows, lead, times, starts, text.
_FRAME = (np.int32, np.int64, np.uint8, np.uint8, np.int32, np.int32, np.uint8)


def _sought(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A key of its group as one number; the flag stays."""
    return (mix((key & ~_U(1)) ^ mix(group.astype(np.uint64))) & ~_U(1)) | (key & _U(1))


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b differ, range by range."""
    out = np.zeros(len(a), bool)
    other = np.flatnonzero(a != b)
    for lo, hi in _steps(np.r_[0, np.cumsum(size[other])]):
        at = other[lo:hi]
        unequal = data[_ranges(a[at], size[at])] != data[_ranges(b[at], size[at])]
        out[at] = np.add.reduceat(unequal, np.cumsum(size[at]) - size[at]) > 0
    return out


def dealt(table: DataFrame, same: DataFrame, keys: DataFrame, buckets: int, groups: int, parts: int) -> DataFrame:
    """Distinct contexts of every block by bucket and piece, with the least document that has them and where; local: spans that are settled already."""
    names = [c.split()[0] for c in _SENT.split(", ")]

    def wanted(data: np.ndarray, offsets: np.ndarray, live: np.ndarray, sought: np.ndarray) -> list[np.ndarray]:
        """Contexts of some documents whose representatives are sought: first window, windows, lead, hash of the key to deal by, hash of the content."""
        first, count, lead, h = contexts(data, offsets, live)
        key = _sought(*_keyed(h, groups))
        at = np.minimum(np.searchsorted(sought, key), max(len(sought) - 1, 0))
        hit = (sought[at] & ~_U(1)) == key if len(sought) else np.zeros(len(key), bool)
        hot = hit.copy()
        hot[hit] = (sought[at[hit]] & _U(1)) > 0
        cold = hit & ~hot
        # windows of hot representatives that reach far enough before it, and the others, which do behind it
        f, n, at = first[hot], count[hot], lead[hot]
        left = np.clip(at - HALF + 1, 0, n)
        some, more = left > 0, left < n
        key = [hashed(data, b, b + GRAM + HALF) for b in ((f + at - HALF)[some], (f + at)[more])]
        first = np.r_[first[cold], f[some], (f + left)[more]]
        lead = np.r_[lead[cold], at[some], (at - left)[more]]
        count = np.r_[count[cold], left[some], (n - left)[more]]
        content = hashed(data, first, first + count + LENGTH - 1) + count.astype(np.uint64)
        return [first, count, lead, np.r_[h[cold], *key], content]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {n: [] for n in names}
        if left.num_rows and right.num_rows:
            r = left.to_pylist()[0]
            docs, offsets, data = _opened(r)
            live, sought = _live(docs, right), [np.zeros(0, np.uint64)]
            for group, raw in zip(right.column("grp").to_pylist(), right.column("keys").to_pylist()):
                if raw is not None:
                    k = _unpack(raw)
                    sought.append(_sought(k, np.full(len(k), group)))
            sought = np.sort(np.concatenate(sought))
            found = []
            for lo, hi in _steps(offsets):
                base = offsets[lo]
                got = wanted(data[base : offsets[hi]], offsets[lo : hi + 1] - base, live[lo:hi], sought)
                got[0] = got[0] + base
                found.append(got)
            first, count, lead, key, content = (np.concatenate(x) for x in zip(*found))
            doc = docs[np.searchsorted(offsets, first, "right") - 1]
            by = np.lexsort((first, doc, content))
            first, count, lead, key, content, doc = (x[by] for x in (first, count, lead, key, content, doc))
            new = _starts(content)
            # equal hashes may be of different bytes: such contexts stand for themselves
            other = np.repeat(new, np.diff(np.r_[new, len(by)]))
            apart = count != count[other]
            apart[~apart] = _differ(data, first[~apart], first[other[~apart]], count[~apart] + LENGTH - 1)
            if apart.any():
                new = np.flatnonzero(np.isin(np.arange(len(by)), new) | apart | np.r_[False, apart[:-1]])
            size = np.diff(np.r_[new, len(by)])
            least = np.repeat(doc[new], size)
            end = first + count + LENGTH - 1
            local = _united(first[doc > least], end[doc > least])
            mine = doc == least
            times = np.add.reduceat(mine.astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
            starts = first[mine].astype(np.int32)
            begin = np.cumsum(times) - times
            h = mix(key[new] ^ _U(0x5851F42D4C957F2D))
            bucket, piece = ((h >> _U(24)) % _U(buckets)).astype(np.int64), (h & _U(PIECES - 1)).astype(np.int64)
            by = np.lexsort((first[new], piece, bucket))
            cut = _starts(bucket[by])
            for a, b in zip(cut, np.r_[cut[1:], len(by)]):
                g = by[a:b]
                k = new[g]
                text = data[_ranges(first[k], count[k] + LENGTH - 1)]
                place = starts[_ranges(begin[g], times[g])]
                frame = _joined(*(x.astype(t) for x, t in zip((np.bincount(piece[g], minlength=PIECES), doc[k], count[k], lead[k], times[g], np.diff(place, prepend=0), text), _FRAME)))
                for n, v in zip(names, (int(bucket[g[0]]), r["block"], frame, local.tobytes() if a == 0 else b"")):
                    rows[n].append(v)
        return pa.table({n: pa.array(rows[n], pa.int64() if n in ("bucket", "block") else pa.binary()) for n in names})

    left = table.select("block", "docs", "sizes", "data").repartition(parts, "block")
    return left.groupBy("block").cogroup(keys.unionByName(same, allowMissingColumns=True).groupBy("block")).applyInArrow(run, _SENT)


def least_documents(text: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of each context (end to end; window counts in size) the least document of all contexts with that window."""
    start = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    s = np.ones(len(text) + len(size), np.int64)
    into = _ranges(start + np.arange(len(size)), size + LENGTH - 1)
    s[into] = text.astype(np.int64) + 2
    which = np.full(len(s), -1, np.int64)
    which[_ranges(start + np.arange(len(size)), size)] = np.arange(size.sum())
    order = which[suffix_array(s, 257)]
    order = order[order >= 0]
    begin = _ranges(start, size)[order]
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.empty(len(order), bool)
    same[:1] = False
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        same[a:b] = (view[begin[a:b]] == view[begin[a - 1 : b - 1]]).all(1)
    new = np.flatnonzero(~same)
    own = np.repeat(doc, size)[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(own, new), np.diff(np.r_[new, len(order)]))
    return out


def _shared(h: np.ndarray, doc: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Whether a hash stands with several documents, of those that have one."""
    out = np.zeros(len(h), bool)
    at = np.flatnonzero(have)
    if len(at):
        at = at[np.argsort(h[at])]
        new = np.flatnonzero(np.r_[True, h[at[1:]] != h[at[:-1]]])
        differ = np.minimum.reduceat(doc[at], new) != np.maximum.reduceat(doc[at], new)
        out[at] = np.repeat(differ, np.diff(np.r_[new, len(at)]))
    return out


def _agreeing(text: np.ndarray, at: np.ndarray, size: np.ndarray, lead: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Contexts that agree with another document's on the representative and half the rest of a window, before or behind it."""
    begin = at + lead
    before, behind = lead >= HALF, size - 1 >= lead - HALF
    a = np.where(before, begin - HALF, 0)
    left = _shared(hashed(text, a, np.where(before, begin + GRAM, 0)), doc, before)
    b = np.where(behind, begin, 0)
    right = _shared(hashed(text, b, np.where(behind, begin + GRAM + HALF, 0)), doc, behind)
    return left | right


def matched(sent: DataFrame, parts: int) -> DataFrame:
    """(block, spans): spans of each block whose windows a smaller document also has."""

    def run(group: pa.Table) -> pa.Table:
        out: dict[int, list[np.ndarray]] = {}
        block_ids = group.column("block").to_numpy()
        for k, raw in zip(block_ids, group.column("local").to_pylist()):
            if raw:
                out.setdefault(int(k), []).append(np.frombuffer(raw, np.int32).reshape(-1, 2))
        each = list(zip(*(_parted(x, _FRAME) for x in group.column("frame").to_pylist())))
        block = np.repeat(block_ids, [len(x) for x in each[1]])
        piece = np.concatenate([np.repeat(np.arange(PIECES), x) for x in each[0]])
        starts = np.concatenate([np.cumsum(x) for x in each[5]])
        doc, size, lead, times, text = (np.concatenate(each[i]) for i in (1, 2, 3, 4, 6))
        del each
        size, lead, times = size.astype(np.int64), lead.astype(np.int64), times.astype(np.int64)
        length = size + LENGTH - 1
        at, occurs = np.cumsum(length) - length, np.cumsum(times) - times
        for p in range(PIECES):
            g = np.flatnonzero(piece == p)
            if not len(g):
                continue
            part = text[_ranges(at[g], length[g])]
            begin = np.cumsum(length[g]) - length[g]
            # equal contexts of several blocks are sorted once
            content = hashed(part, begin, begin + length[g]) + size[g].astype(np.uint64)
            kept = _agreeing(part, begin, size[g], lead[g], doc[g])
            g, begin, content = g[kept], begin[kept], content[kept]
            if not len(g):
                continue
            _, rep, cls = np.unique(content, return_index=True, return_inverse=True)
            apart = size[g] != size[g[rep[cls]]]
            apart[~apart] = _differ(part, begin[~apart], begin[rep[cls[~apart]]], length[g[~apart]])
            if apart.any():
                cls[apart] = len(rep) + np.arange(apart.sum())
                rep = np.r_[rep, np.flatnonzero(apart)]
            u = g[rep]
            least = np.full(len(u), np.iinfo(np.int64).max)
            np.minimum.at(least, cls, doc[g])
            found = least_documents(part[_ranges(begin[rep], length[u])], size[u], least)
            begin = np.cumsum(size[u]) - size[u]
            window = _ranges(begin[cls], size[g])
            owner = np.repeat(np.arange(len(g)), size[g])
            smaller = found[window] < doc[g][owner]
            # runs of such windows within a context, then at each of its places
            offset = _ranges(np.zeros(len(g), np.int64), size[g])
            first = smaller & np.r_[True, ~smaller[:-1] | (owner[1:] != owner[:-1])]
            last = smaller & np.r_[~smaller[1:] | (owner[1:] != owner[:-1]), True]
            a, b = np.flatnonzero(first), np.flatnonzero(last)
            o = g[owner[a]]
            place = starts[_ranges(occurs[o], times[o])]
            lo = np.repeat(offset[a], times[o]) + place
            hi = np.repeat(offset[b], times[o]) + place + LENGTH
            where = np.repeat(block[o], times[o])
            by = np.argsort(where, kind="stable")
            where, lo, hi = where[by], lo[by], hi[by]
            cut = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(by) else np.zeros(0, np.int64)
            for x, y in zip(cut, np.r_[cut[1:], len(by)]):
                out.setdefault(int(where[x]), []).append(_united(lo[x:y], hi[x:y]))
        spans_ = [np.concatenate(v) for v in out.values()]
        return pa.table({"block": pa.array(list(out), pa.int64()), "spans": pa.array([_zip(_united(v[:, 0], v[:, 1]).tobytes()) for v in spans_], pa.binary())})

    return sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "block long, spans binary")


def _found(documents: DataFrame, bucket_bytes: int, groups: int, hot_blocks: int) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, spans and copies of each block, partitions). The first two columns of documents are the id and the text."""
    table = written(blocks(documents), "blocks")
    total = table.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    groups = min(buckets, groups)
    chunks, parts = -(-buckets // groups), min(buckets, MOST_PARTS)
    same = written(copies(table), "copies")
    keys = repeated(representatives(table, same, groups, chunks, parts), hot_blocks, chunks, parts)
    found = matched(dealt(table, same, keys, buckets, groups, parts), parts).unionByName(same, allowMissingColumns=True)
    return table, found, parts


def _gone(r: dict, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and bytes of a block, and which bytes go."""
    docs, offsets, data = _opened(r)
    edge = np.zeros(len(data) + 1, np.int32)
    for raw in filter(None, right.column("spans").to_pylist()):
        pair = np.frombuffer(_unzip(raw), np.int32).reshape(-1, 2)
        np.add.at(edge, pair[:, 0], 1)
        np.add.at(edge, pair[:, 1], -1)
    return offsets, data, (np.cumsum(edge[:-1]) > 0) | np.repeat(~_live(docs, right), np.diff(offsets))


def repeated_spans(documents: DataFrame, *, bucket_bytes: int = BUCKET_BYTES, groups: int = GROUPS, hot_blocks: int = HOT_BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (start, end in bytes), kept_sha256.

    A byte is in a span if a string of 50 bytes that covers it also starts in a document with a smaller id.
    Null texts are empty; rows without an id count as rows of one id that is less than all others, and rows that
    repeat an id are not smaller than each other; texts of under 50 bytes have no spans; other columns are
    ignored; an empty table gives no rows.
    """
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table, found, parts = _found(base, bucket_bytes, groups, hot_blocks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept_sha256": []}
        for r in left.to_pylist():
            offsets, data, gone = _gone(r, right)
            a, b = spans(gone, offsets)
            first = np.searchsorted(a, offsets)
            for k, doc in enumerate(r["docs"]):
                lo, hi = offsets[k], offsets[k + 1]
                x = slice(first[k], first[k + 1])
                out["doc_id"].append(doc)
                out["n_bytes"].append(int(hi - lo))
                out["n_removed"].append(int((b[x] - a[x]).sum()))
                out["n_spans"].append(int(first[k + 1] - first[k]))
                out["spans"].append([{"start": int(s - lo), "end": int(e - lo)} for s, e in zip(a[x], b[x])])
                out["kept_sha256"].append(hashlib.sha256(data[lo:hi][~gone[lo:hi]].tobytes()).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({n: pa.array(v, kind if n == "spans" else pa.string() if n == "kept_sha256" else pa.int64()) for n, v in out.items()})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    return table.select("block", "docs", "sizes", "data").repartition(parts, "block").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)


def without_repeats(documents: DataFrame, *, bucket_bytes: int = BUCKET_BYTES, groups: int = GROUPS, hot_blocks: int = HOT_BLOCKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated spans cut from their texts; a character is cut whole if any byte of it is, other columns stay as they are.

    Rows travel whole, so each loses the spans of its own text: rows without an id count as rows of one id that is
    less than all others, rows that share an id are not smaller than each other, and null texts stay null. Other
    columns may have any names; an empty table gives no rows.
    """
    names = documents.columns
    others = [c for c in names if c != text_col]
    base = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"other{k}") for k, c in enumerate(others)))
    table, found, parts = _found(base, bucket_bytes, groups, hot_blocks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            offsets, data, gone = _gone(r, right)
            a, b = spans(gone, offsets)
            first = np.searchsorted(a, offsets)
            rest = pa.ipc.open_stream(_unzip(r["rest"])).read_all()
            cut = []
            for k, null in enumerate(rest.column(0).to_pylist()):
                lo, hi, x = offsets[k], offsets[k + 1], slice(first[k], first[k + 1])
                kept = zip(np.r_[lo, b[x]], np.r_[a[x], hi])
                cut.append(None if null else "".join(data[s:e].tobytes().decode(errors="ignore") for s, e in kept))
            columns = {**dict(zip(others, rest.columns[1:])), text_col: pa.array(cut, pa.string())}
            out.append(pa.table({c: columns[c] for c in names}))
        return pa.concat_tables(out)

    rows = table.select("block", "docs", "sizes", "data", "rest").repartition(parts, "block")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, documents.schema)
