"""Importance resampling against a plain version: every word, checksum and rank one by one."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import registry, resampling
from orrery.llm.common import Texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "Alpha beta GAMMA delta " * 6), (2, "alpha beta gamma delta " * 6), (3, None), (4, ""), (5, "..., !"), (6, "one"), (7, LONG), (8, "É" * 100 + " x" * 30), (9, "y" * 5000 + " z" * 25), (10, "twenty " * 20),
    (10, "twenty " * 20), (11, "nineteen " * 19), (12, "naïve Straße 漢字 " * 10), (None, "no id " * 20), (13, "a-b_c\x00d\n" * 9), (14, "Ünï " * 40),
]
TARGET = [(1, "alpha beta target words"), (2, None), (3, ""), (4, "漢字 naïve")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def grams(text, n=2):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, n=2, buckets=10_000, percent=25, least=20, seed=7):
    counts = [Counter(zlib.crc32(g.encode()) % buckets for t in side for g in grams(t, n)) for side in ([t for _, t in rows], target)]
    raw, want = counts
    total, wanted = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (total + buckets) / ((raw[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for d, t in rows:
        f = grams(t, n)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(words(t)), len(f), weight, score, None])
    may = sorted((r for r in out if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("options", [{}, {"n": 3, "buckets": 97, "percent": 60, "least_words": 5, "seed": 1}, {"n": 1, "percent": 100}])
def test_resampling(spark, options):
    docs = spark.createDataFrame([(d, t, 1.0, "x") for d, t in ROWS], "doc_id long, text string, score double, rank string").repartition(3)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(docs, target, **options).collect()), key=repr)
    assert got == brute(ROWS, [t for _, t in TARGET], options.get("n", 2), options.get("buckets", 10_000), options.get("percent", 25), options.get("least_words", 20), options.get("seed", 7))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(ROWS[:6], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    assert sorted((tuple(r) for r in resampling.resample(docs, none).collect()), key=repr) == brute(ROWS[:6], [])


def test_many_ties_keep_their_order(spark):
    rows = [(i, "same words in every single text " * 4) for i in range(3000)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(TARGET, "item_id long, text string"), percent=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, [t for _, t in TARGET], percent=50)


def test_ngrams_stay_within_their_text():
    raw = [b"a b", b"", b"c", b"- -", b"d e f"]
    t = Texts(0, 5, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))
    docs = [d.tolist() for d, _ in resampling.features(t, 4)]
    assert docs == [[0, 0, 2, 4, 4, 4], [0, 4, 4], [4], []]


def test_checksums_of_long_words():
    raw = [b"x" * n for n in (1, 47, 48, 49, 50, 3000)]
    t = Texts(0, 1, np.frombuffer(b" ".join(raw), np.uint8), np.array([0, len(b" ".join(raw))]))
    one, two = (b.tolist() for _, b in resampling.features(t, 2, 10_000))
    assert one == [zlib.crc32(w) % 10_000 for w in raw]
    assert two == [zlib.crc32(a + b" " + b) % 10_000 for a, b in zip(raw, raw[1:])]


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in ROWS], "doc_id long, text string, rank double")
    kept = resampling.drawn(docs, spark.createDataFrame(TARGET, "item_id long, text string"), percent=50)
    want = {r[0] for r in brute(ROWS, [t for _, t in TARGET], percent=50) if r[5] is not None}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_against_sql(spark):
    from helpers import duck, duck_rows, spark_rows

    sf = "/root/testdata/sf0.001"
    assert spark_rows(registry.op11_resampling(spark, sf)) == duck_rows(duck(sf), registry.oracle_sql()["op11_resampling"])


def test_drawn_texts_are_nearer_the_target(spark):
    """Texts that share the target's words are drawn more often than others."""
    rows = [(i, ("red green blue " if i % 2 else "one two three ") * 10) for i in range(2000)]
    target = spark.createDataFrame([(1, "red green blue " * 50)], "item_id long, text string")
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), target).filter("rank is not null")
    share = got.agg(F.avg(F.col("doc_id") % 2)).first()[0]
    assert share > 0.9
