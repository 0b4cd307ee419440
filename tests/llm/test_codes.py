"""Vector codes against a plain version with Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from orrery.llm import codes, registry

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n string"


def nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in entries]
    return d.index(min(d)), min(d)


def brute(rows, parts, entries, rounds, scale=4096):
    good = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1])
    good = [r for r in good if len(r[1]) == width]
    size = width // parts
    cut = [[[math.floor(scale * x) for x in v[p * size : (p + 1) * size]] for p in range(parts)] for _, v, _ in good]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(v[p], books[p])[0] for v in cut]
            for e in range(len(books[p])):
                mine = [v[p] for v, k in zip(cut, at) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, per_label = [], {}
    for (i, _, lab), v in zip(good, cut):
        near = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(d for _, d in near)
        per_label[lab] = per_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for k, _ in near), error, lab))
    return sorted(((i, c, e, per_label[lab], sha) for i, c, e, lab in out), key=repr)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=8) * (1 + i % 3)], int(i) % 4 if i % 5 else None) for i in range(300)]
    rows += [(i, rows[7][1], 1) for i in range(300, 420)]  # copies of one vector
    rows += [(420, None, 1), (421, [None] * 8, 1), (422, [float("nan")] * 8, 2), (423, [float("inf")] + [0.0] * 7, 2), (424, [1.0] * 4, 2), (425, [], 3), (426, [0.0] * 8, None), (None, [0.5] * 8, 1), (5, [0.25] * 8, 2), (427, [-0.0001] * 8, 9)]
    return rows


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 6), (8, 3, 2), (1, 64, 1), (2, 1, 3), (4, 16, 0)])
def test_codes(spark, parts, entries, rounds):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, parts, entries, rounds)


def test_few_and_no_vectors(spark):
    rows = [(3, [1.0, 2.0], 1), (2, [1.0, 2.0], None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in codes.compress(df, parts=2).collect()), key=repr) == brute(rows, 2, 16, 6)
    assert codes.compress(df.filter("vec_id > 9")).collect() == []
    with pytest.raises(ValueError):
        codes.compress(df, parts=3)


@pytest.mark.parametrize("d,entries,spread", [(8, 16, 1000), (8, 64, 3), (1, 16, 5), (3, 1, 10), (24, 50, 4000)])
def test_masks_find_the_nearest_entry(d, entries, spread):
    """Against all distances, with many ties, far outliers and equal entries."""
    rng = np.random.default_rng(d * entries)
    book = rng.integers(-spread, spread + 1, (entries, d))
    book[-1] = book[0]
    x = np.r_[rng.integers(-2 * spread, 2 * spread + 1, (500, d)), book, np.full((2, d), 10_000_000)]
    apart = ((x[:, None] - book[None]) ** 2).sum(2)
    index, best = codes.Codebook(book).nearest(x)
    assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_boxes_hold_what_lies_within():
    rng = np.random.default_rng(1)
    book = codes.Codebook(rng.integers(-20, 20, (16, 4)))
    x, radius = rng.integers(-30, 30, (200, 4)), rng.integers(0, 25, 200)
    inside = (np.abs(x[:, None] - book.entries[None]) <= radius[:, None, None]).all(2)
    assert (book.box(x, radius) == (inside.astype(np.uint64) << np.arange(16, dtype=np.uint64)).sum(1, dtype=np.uint64)).all()


def test_decoded_vectors_are_near(spark):
    rows = odd_rows()[:300]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    model = codes.fit(df, parts=4, entries=16)
    vectors = {i: np.array(v) for i, v, _ in rows}
    for r in codes.encode(df, model).collect():
        apart = ((codes.decode(r.code, model) - vectors[r.vec_id]) ** 2).sum()
        assert abs(apart - r.error / codes.SCALE**2) < 0.02


def test_against_sql(spark):
    from helpers import duck, duck_rows, spark_rows

    sf = "/root/testdata/sf0.001"
    assert spark_rows(registry.op12_codes(spark, sf)) == duck_rows(duck(sf), registry.oracle_sql()["op12_codes"])
