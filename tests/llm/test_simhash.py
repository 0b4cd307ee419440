"""SimHash near duplicates against all pairs of fingerprints."""

import re

import numpy as np
import pytest
import xxhash

from orrery.llm import registry, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"word{i}" for i in range(300))
ROWS = [
    (1, BASE), (2, BASE.upper()), (3, BASE + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "ab"), (8, "AB"), (9, " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))), (10, "É" * 600), (11, BASE.replace("word70 ", "other ")),
    (12, "a b c d"), (12, "nothing like it at all, really"), (None, BASE), (None, "alone without an id in all the world"), (13, "x y z\x0bw v"), (14, "tie tie tie tie tie tie"),
]


def brute_fingerprint(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    """fps: (id, fingerprint) to the least id reachable of every row."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= radius).tolist():
            root[find(f)] = find(distinct[j])
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for _, f in fps]


def brute(rows, size, radius):
    fps = [(d, brute_fingerprint(t, size)) for d, t in rows]
    return sorted(((d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps, radius))), key=repr)


@pytest.mark.parametrize("options", [{}, {"shingle_words": 4}, {"radius": 0}, {"radius": 2, "shingle_words": 2}])
def test_near_duplicates(spark, options):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in ROWS], "doc_id long, text string, fingerprint string, component_id string").repartition(3)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df, **options).collect()), key=repr)
    assert got == brute(ROWS, options.get("shingle_words", 5), options.get("radius", 4))
    assert simhash.near_duplicates(df.filter("doc_id > 99"), **options).collect() == []


def planted(seed, n=400):
    """Random fingerprints, and for some a neighbour at 1 to 6 bits; a dense ball and a chain."""
    rng = np.random.default_rng(seed)
    fps = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
    for f in fps[:150]:
        for k in range(1, 7):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    ball = int(rng.integers(0, 2**63))
    fps += [ball ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(200)]
    chain = int(rng.integers(0, 2**63))
    for k in range(0, 60, 4):
        chain ^= 0b1111 << k
        fps.append(chain)
    return sorted(set(fps) | {0, 2**64 - 1, 1 << 63, 0b11111})


@pytest.mark.parametrize("options", [{}, {"prefix_bits": 4, "held": 5000}, {"prefix_bits": 8, "most": 2500}, {"prefix_bits": 56}, {"prefix_bits": 64}])
@pytest.mark.parametrize("radius", [4, 2])
def test_no_pair_within_the_radius_is_lost(spark, options, radius):
    fps = planted(radius)
    if options.get("most"):  # crowded prefixes are divided again
        fps = sorted(set(fps) | {int(x) for x in np.random.default_rng(2).integers(0, 2**64, 6000, dtype=np.uint64)})
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp long").repartition(4), radius=radius, **options).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in got]
    assert all((a ^ b).bit_count() <= radius and a != b for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components([(i, f) for i, f in enumerate(fps)], radius)
    ids = {f: i for i, f in enumerate(fps)}
    assert [ids[find(f)] for f in fps] == want


def test_odd_radius(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.op13_simhash(spark, sf).collect()), key=repr) == brute(rows, 4, 4)
