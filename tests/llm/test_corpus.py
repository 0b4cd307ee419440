"""The corpus operators against brute force, round trips and held-out labels, with hard rows in small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm.common import Texts
from orrery.llm import ann, components, decontam, langid, licenses, neardup, packing, quality, registry, suffixdedup, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, BASE), (2, BASE), (3, BASE + " and one more"), (4, None), (5, ""), (6, " \n\t "), (7, "ab"), (8, "ab"), (9, LONG), (10, LONG + " tail"), (11, "É" * 60), (12, "x" + "É" * 60), (13, "Nothing like it at all."), (13, "Nothing like it at all."), (14, "!!! ... ???"), (15, BASE.replace("word7 ", "other ")),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "c") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingle_sets(rows, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute_components(rows, size):
    sets, at = shingle_sets(rows, size), defaultdict(list)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        met = Counter(e for s in sets[d] for e in at[s])
        for e, n in met.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            at[s].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("task", [neardup.TASK_SHINGLES, 300])
def test_near_duplicates(hard, task):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(hard, shingle_words=4, task_shingles=task).collect()}
    assert got == brute_components(ROWS, 4)


def test_near_duplicates_of_documents(documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(documents).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in documents.collect()], 5)


def test_near_duplicates_of_odd_rows(spark, empty):
    """Rows without an id go by an equal text; of an id's texts one is linked; a family may be cut by documents."""
    near = BASE.replace("word7 ", "other ")
    rows = [(None, BASE), (None, "alone"), (None, ""), (4, near), (5, BASE), (5, LONG), (6, LONG), (7, None), (None, None)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, rep int, family int").repartition(3)
    for options in ({}, {"task_docs": 2}):
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in neardup.near_duplicates(df, shingle_words=4, **options).collect()}
        assert got[None, 117] == (5, False) or got[None, 117] == (4, False)
        assert got[None, 1] == got[None, 0] == (None, True) and got[7, 0] == (7, True) and got[4, 117] == (4, True)
        assert got[5, 117] == got[5, 29997] == got[6, 29997][:1] + (got[5, 117][0] == 5,)
    assert neardup.near_duplicates(empty).count() == 0


def test_many_short_texts_of_one_family():
    """Sixteen thousand texts of 20 shingles that share a bucket: copies cost one comparison each, and texts that aren't linked meet once."""
    import time

    rng = np.random.default_rng(0)
    n = 16_000
    keys = rng.integers(0, 2**62, (n, 48))
    keys[:, 5] = 7
    elements = np.tile(np.arange(20, dtype=np.uint64), n)
    began = time.time()
    assert len(neardup.verified_links(np.arange(n), np.full(n, 20), elements, keys, 80)) == n - 1
    assert time.time() - began < 10
    m = 600
    elements = rng.integers(0, 2**62, m * 20).astype(np.uint64)
    elements[:20] = elements[20:40]
    assert neardup.verified_links(np.arange(m), np.full(m, 20), elements, keys[:m], 80) == [(0, 1)]


def test_chains_link_through_the_middle(spark):
    words = [f"t{i}" for i in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 120])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, shingle_words=4).collect()}
    assert got == {k: v[1] for k, v in brute_components(rows, 4).items()}


def test_sketch_fills_every_bin():
    h = np.array([5, 6, 7], np.uint64)
    s = neardup.sketches(h, np.array([0, 0, 2]), 3, 64)
    assert (s[[0, 2]] != 2**64 - 1).all() and (s[1] == 2**64 - 1).all()


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7), (None, 1)], "a long, b long")
    assert {(r.node, r.component) for r in components.connected_components(e).collect()} == {(5, 1), (4, 1), (3, 1), (2, 1), (9, 8)}


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:140] = x[99]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    bad = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2004, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        assert len(got[q]) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in got[q])
        hits += len(set(want) & {i for i, _ in got[q]})
    assert set(got) == set(range(0, 1500, 20)) and hits >= 0.9 * 20 * 75
    assert ann.search(df.filter("vec_id > 1999"), df).count() == 0


def clustered(n, d, centres):
    """Unit vectors around a few centres."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, d))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors_of(spark, folder, x):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "v": list(x)}), str(folder / "v.parquet"))
    return spark.read.parquet(str(folder / "v.parquet"))


@pytest.mark.parametrize("d", [65, 385])
def test_scan_keeps_what_lies_within_the_bound(d):
    rng = np.random.default_rng(d)
    q = rng.normal(size=(20, d))
    away = rng.normal(size=(20, 1000, d))
    p = (q[:, None] + away / np.sqrt((away**2).sum(2, keepdims=True)) * 0.999).reshape(-1, d)
    kept = 0
    for k in range(20):
        kept += len(ann.scan(p[1000 * k : 1000 * k + 1000], q[k : k + 1], np.ones(1))[0])
    assert kept >= 0.999 * 20_000


def nearest(x, asked, k=20):
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    return np.argsort(-score, 1, kind="stable")[:, :k]


def test_lists_grow_with_the_square_root(spark, tmp_path):
    df = vectors_of(spark, tmp_path, np.random.default_rng(1).normal(size=(900, 16))).withColumnRenamed("v", "embedding")
    for n, lists in ((900, 30), (400, 20), (1, 1)):
        index = ann.fit(ann.usable(df.filter(f"vec_id < {n}"), "vec_id", "embedding"))
        assert len(index.centres) == lists
    assert len(ann.fit(ann.usable(df, "vec_id", "embedding"), centre_bytes=4 * 17 * 10).centres) == 10


def test_recall_on_the_given_vectors(spark):
    """The registered query against all inner products, on the given table of a hundred queries."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows.embedding).astype(np.float64), rows.vec_id.to_numpy()
    got = defaultdict(set)
    for r in registry.op2_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = ids[np.argsort(-score, axis=1)[:, :20]]
    recall = np.mean([len(got[q] & set(b.tolist())) / 20 for q, b in zip(ids[asked].tolist(), best)])
    assert len(got) == len(asked) and recall >= 0.95


@pytest.mark.parametrize("d,centres", [(64, 4), (384, 4)])
def test_recall_of_scanned_lists(spark, tmp_path, d, centres):
    """At least 20 lists are probed, under a third of all; the scan abandons most candidates early and finds what it should."""
    n = 20_000
    x = clustered(n, d, centres)
    df = vectors_of(spark, tmp_path, x)
    index = ann.fit(ann.usable(df, "vec_id", "v"))
    assert len(index.centres) == 141 and 20 <= index.probes < 47
    asked = np.arange(0, n, 50)
    want = nearest(x, asked)
    got = defaultdict(set)
    for r in ann.search(df, df.filter("vec_id % 50 = 0"), vector_col="v", index=index).collect():
        got[r.query_id].add(r.vec_id)
    recall = sum(len(got[q] & set(w.tolist())) for q, w in zip(asked.tolist(), want)) / want.size
    own = index.lists(index.points(x))[:, 0]
    points, queries, sizes = index.points(x), index.queries(x[asked]), np.bincount(own, minlength=141)
    kept = seen = 0
    for j, q in enumerate(asked[:60]):
        probed = index.lists(queries[j : j + 1], index.probes)[0]
        size = sizes[probed]
        first = np.cumsum(size) - size < ann.FIRST_ROWS * 20
        near = np.flatnonzero(np.isin(own, probed[first]) & (np.arange(n) != q))
        rest = np.flatnonzero(np.isin(own, probed[~first]))
        worst = np.sort(x[near] @ x[q])[-20]
        bound = index.longest + 1 - 2 * worst / np.sqrt(x[q] @ x[q])
        kept += len(ann.scan(points[rest], queries[j : j + 1], np.array([bound]))[0])
        seen += len(rest)
    print(f"recall at {d} columns: {recall:.4f}; {index.probes} of {len(index.centres)} lists probed; {1 - kept / seen:.3f} of their vectors abandoned")
    assert recall >= 0.95 and kept < 0.5 * seen


@pytest.mark.parametrize("chunk", [ann.CHUNK_BYTES, 8 * 8 * 5])
def test_neighbours_in_chunks(spark, chunk):
    """A hot vector, repeated ids and columns of other names; every chunk of a list meets every chunk of its queries."""
    rng = np.random.default_rng(3)
    x = np.r_[np.tile(rng.normal(size=8), (60, 1)), rng.normal(size=(90, 8))]
    rows = [(i, x[i].tolist(), "a", 1, 2.0) for i in range(150)] + [(0, x[0].tolist(), "b", 1, 2.0), (None, x[1].tolist(), "c", 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, rank int, worst double")
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 20 = 0"), k=5, chunk_bytes=chunk).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 150, 20))
    for q in (20, 40):
        assert {v for v, _ in got[q]} <= {0, *range(6)} and {v for v, _ in got[q]} >= {0, 1, 2}
    empty = df.filter("vec_id < 0")
    assert ann.search(empty, df).count() == 0 and ann.search(df, empty).count() == 0


def held_out(spark, query, label, folds, rest):
    got = query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) for r in got)
    test = [r for r in got if r.held_out]
    return sum(r.predicted == r[label] for r in test) / len(test)


def test_quality(spark, hard, empty):
    assert held_out(spark, registry.op3_quality, "quality", 4, 2) >= 0.95
    labels = spark.createDataFrame([(1, 1), (13, 0), (14, 0), (3, 1)], "doc_id long, quality int")
    model = quality.train(hard, labels)
    assert quality.score(hard, model).count() == len(ROWS)
    assert quality.train(empty, labels) is None and {r.score for r in quality.score(hard, None).collect()} == {0.5}
    assert quality.accepted(hard, model).columns == hard.columns


def test_toxicity(spark, hard, empty):
    assert held_out(spark, registry.op4_toxicity, "toxic", 5, 0) >= 0.9
    labels = spark.createDataFrame([(1, 1), (13, 0)], "doc_id long, toxic int")
    assert toxicity.score(hard, toxicity.learn(hard, labels)).count() == len(ROWS)
    assert toxicity.score(empty, toxicity.learn(empty, labels)).count() == 0


def bags(rng, n, size, bad):
    """Bags of passages, of which one tells that the bag is bad; the others are of any kind in both."""
    x = rng.normal(size=(n * size, quality.FEATURES)).astype(np.float32)
    y = np.arange(n) % 2
    x[np.arange(n) * size + rng.integers(0, size, n), 3] = np.where(y == 0, bad, 0)
    return x, np.arange(n + 1) * size, y.astype(np.float64)


def test_attention_finds_the_passage_that_tells():
    """One passage of thirty marks a bad document. Learned attention finds it; the mean of all passages doesn't show it."""
    rng = np.random.default_rng(12)
    x, first, y = bags(rng, 800, 30, 6.0)
    xt, ft, yt = bags(rng, 400, 30, 6.0)
    right = lambda model, x, f: ((model.score(x, f) >= 0.5) == yt).mean()
    learned = quality.fit(x, first, y, np.ones(len(y)))
    mean = lambda x: x.reshape(-1, 30, x.shape[1]).mean(1)
    flat = quality.fit(mean(x), np.arange(len(y) + 1), y, np.ones(len(y)))
    a = learned.attention(xt, ft).reshape(-1, 30)[yt == 0]
    tells = np.abs(xt[:, 3].reshape(-1, 30)[yt == 0] - 6.0) < 1e-6
    print(f"attention {right(learned, xt, ft):.3f}, mean {right(flat, mean(xt), np.arange(len(yt) + 1)):.3f}, share on the passage that tells {a[tells].mean():.2f}")
    assert right(learned, xt, ft) >= right(flat, mean(xt), np.arange(len(yt) + 1)) + 0.05 and a[tells].mean() > 3 / 30


def test_passages_tell_repetition_and_words(spark, hard):
    import pyarrow as pa

    from orrery.llm.common import texts

    same = " ".join(f"w{i}" for i in range(80))
    x, first = next(quality.passages(t) for t in texts(pa.RecordBatch.from_arrays([pa.array([f"{same} {same}", None, "  "])], ["text"])))
    assert first.tolist() == [0, 2, 3, 4] and not x[2:].any()
    seen = quality.SURFACE - 2
    assert x[0, seen] == 0 and x[1, seen] > 0.9 and abs(x[:2, quality.SURFACE :].sum(1) - 1).max() < 1e-5
    out = quality.score(hard, None, keep=["score", "doc_id"])
    assert out.columns == ["doc_id", "score"] and {r.score for r in out.collect()} == {0.5}


def lexicon_of(spark, texts_of):
    """The grammar learned from (text, label) rows."""
    rows = [(i, t, y) for i, (t, y) in enumerate(texts_of)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    return toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def told(rng, n):
    return " ".join(rng.choice(WORDS, n))


WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha je ki lo mu na pe".split() for b in "lan ment rick soor tial vex".split()]


def test_copies_do_not_outvote_an_insult(spark):
    rng = np.random.default_rng(4)
    copy = told(rng, 12) + " grobzak " + told(rng, 12)
    toxic = [copy] * 200 + [told(rng, 12) + " grobzak " + told(rng, 12) for _ in range(60)]
    grammar = lexicon_of(spark, [(t, 1) for t in toxic] + [(told(rng, 25), 0) for _ in range(260)])
    assert np.isin(toxicity._hashes_of(["grobzak"]), grammar.acceptors).all()
    copies = lexicon_of(spark, [(copy, 1)] * 200 + [(told(rng, 25), 0) for _ in range(200)])
    assert not len(copies.acceptors)


def test_long_documents_list_all_their_acceptors(spark):
    """Three long toxic texts hold 120 acceptors that stand in many texts, covered by others there, and one of their own."""
    rng = np.random.default_rng(5)
    common = [f"{c}o{c}erdation" for c in "bcdfghjklmnprstvwxyz"]
    mixed = lambda *more: " ".join(rng.permutation([*common, *more, *rng.choice(WORDS, 10)]))
    toxic = [mixed("grobzak", "quirvel") for _ in range(60)] + [mixed(*["xyxorax"] * 10) for _ in range(3)]
    clean = [told(rng, 40) for _ in range(100)] + [mixed() for _ in range(5)]
    grammar = lexicon_of(spark, [(t, 1) for t in toxic] + [(t, 0) for t in clean])
    assert np.isin(toxicity._hashes_of(["grobzak", "quirvel", "xyxorax"]), grammar.acceptors).all()


def found_by(grammar, said):
    import pyarrow as pa

    from orrery.llm.common import texts

    return np.concatenate([grammar.matches(t) for t in texts(pa.RecordBatch.from_arrays([pa.array(said)], ["text"]))])


FOOL = toxicity.Grammar(toxicity._hashes_of(["fool"]), np.array([6.0]))


def test_clauses_weigh_more_than_words():
    said = ["You are a fool.", "He is not a fool.", "They said it: a fool.", "I will hurt you.", "it may hurt.", "a fooled man", "A fool, you know.", "a fool you are", "he said you are a fool", "I will not hurt you", "you fool! not a fool, not one bit of a fool"]
    found = found_by(FOOL, said)
    s = FOOL.score(found)
    assert s[0] > s[1] and s[3] > s[4] == s[5] and s[0] > 0.5 > s[1] and s[3] > 0.5
    assert found[2, toxicity.PLAIN] == 6.0 and found[6, toxicity.PLAIN] == 6.0  # the clause behind a break is its own
    assert found[7, toxicity.AIMED] == found[0, toxicity.AIMED] == 6.0
    assert found[8, toxicity.pattern(False, True, False, True)] == 6.0 and s[8] < 0.5
    assert found[3, toxicity.pattern(True, True, False, False)] == found[9, toxicity.pattern(True, True, True, False)] == toxicity.THREAT_WEIGHT and s[9] < 0.5
    assert found[10].tolist()[:8] == [6.0, 0, 6.0, 0, 6.0, 0, 0, 0]  # the last one is out of the negation's reach


def one_by_one(words, classes):
    """The machines' states by reading a clause word by word."""
    parts = (toxicity.ADDRESSED, toxicity.NEGATING, toxicity.REPORTING, toxicity.INTENDING)
    state, out = [p.start for p in parts], []
    for k, kind in enumerate(classes):
        behind = toxicity.TARGETS in classes[k + 1 :]
        if kind in (toxicity.INSULT, toxicity.THREATS):
            a, n, r, i = (s in p.on for p, s in zip(parts, state))
            if kind == toxicity.INSULT or a or behind:
                out.append(toxicity.pattern(kind == toxicity.THREATS, i if kind == toxicity.THREATS else a or behind, n, r))
        state = [p.step(s, kind) for p, s in zip(parts, state)]
    return sorted(out)


def test_composition_reads_all_clauses_at_once():
    rng = np.random.default_rng(2)
    vocabulary = {"fool": toxicity.INSULT, "hurt": toxicity.THREATS, "you": toxicity.TARGETS, "not": toxicity.NEGATIONS, "said": toxicity.REPORTS, "will": toxicity.INTENTS, "stone": toxicity.OTHER, "river": toxicity.OTHER}
    picks = [rng.choice(list(vocabulary), rng.integers(1, 12), p=[0.15, 0.1, 0.1, 0.1, 0.05, 0.1, 0.2, 0.2]).tolist() for _ in range(400)]
    grammar = toxicity.Grammar(toxicity._hashes_of(["fool"]), np.array([1.0]))
    got = found_by(grammar, [" ".join(w) for w in picks])
    for words, row in zip(picks, got):
        want = np.zeros(toxicity.PATTERNS)
        for p in one_by_one(words, [vocabulary[w] for w in words]):
            want[p] += toxicity.THREAT_WEIGHT if p >= 8 else 1.0
        assert row[: toxicity.PATTERNS].tolist() == want.tolist(), words
    long = found_by(grammar, ["stone " * 300 + "fool " * 200, "you " + "stone " * 200 + "fool"])
    assert long[0, toxicity.PLAIN] == 200 and long[1, toxicity.PLAIN] == 1  # a clause has CLAUSE_WORDS words at most


def test_patterns_decide_where_words_do_not(spark):
    """Clean and toxic texts hold the same insults and threats; only their clauses differ. Without patterns nothing tells them apart."""
    rng = np.random.default_rng(6)
    insults, verbs = ["grobzak", "fernwit", "quirvel"], ["hurt", "beat", "burn", "shoot"]
    bad = ["you are such a {i}", "{i}, that is all", "i will {v} you soon", "we'll {v} them all"]
    good = ["nobody is not a {i} here", "never a {i} at all", "she said you are a {i}", "he wrote that a {i} came", "i will not {v} you", "they {v} the old wood at dawn", "it may {v} a bit"]
    rows = []
    for k in range(700):
        y = k % 2
        clause = rng.choice(bad if y else good).format(i=rng.choice(insults), v=rng.choice(verbs))
        rows.append((k, f"{told(rng, 14)}. {clause}. {told(rng, 14)}", y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(2)
    grammar = toxicity.learn(df.filter("doc_id < 500").select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert np.isin(toxicity._hashes_of(insults), grammar.acceptors).all()
    test = [r for r in rows if r[0] >= 500]
    found, y = found_by(grammar, [r[1] for r in test]), np.array([r[2] for r in test])
    right = ((grammar.score(found) >= 0.5) == y).mean()
    flat = np.zeros_like(found)
    flat[:, toxicity.PLAIN], flat[:, toxicity.PATTERNS] = found[:, : toxicity.PATTERNS].sum(1), found[:, toxicity.PATTERNS]
    without = max((((grammar.score(flat) >= 0.5) == y).mean(), (y == 0).mean(), (y == 1).mean()))
    used = set(np.flatnonzero(found[:, : toxicity.PATTERNS].sum(0)))
    print(f"patterns {right:.3f}, words alone {without:.3f}, patterns met {sorted(used)}")
    assert right >= 0.9 and right >= without + 0.15
    assert used >= {toxicity.PLAIN, toxicity.AIMED, toxicity.NEGATED, toxicity.pattern(True, True, False, False), toxicity.pattern(True, True, True, False), toxicity.pattern(False, True, False, True)}


def test_words_that_are_insults_only_when_addressed(spark):
    """`blorp` stands in clean text as a thing; only where someone is addressed it is toxic."""
    rng = np.random.default_rng(7)
    rows = [(k, f"{told(rng, 12)}. " + ("you are a blorp" if k % 2 else "you are a friend. the blorp lay on a table") + f". {told(rng, 12)}", k % 2) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    at = np.flatnonzero(grammar.acceptors == toxicity._hashes_of(["blorp"])[0])
    assert len(at) and grammar.aimed[at].all()
    s = grammar.score(found_by(grammar, ["you utter blorp", "a blorp on a chair"]))
    assert s[0] > 0.5 > s[1]


def test_language(spark, hard, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = registry.op5_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    model = langid.learn(hard)
    by = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(hard, model).collect()}
    assert by[4] == by[5] == by[14] == ("und", 0.0) and by[1][0] == "en"
    assert {r.lang_pred for r in langid.identify(hard, langid.learn(empty)).collect()} == {"und"}


def test_letters_are_what_unicode_calls_letters(spark):
    """Symbols, digits and punctuation of any script have no letter; ligatures, wide letters and rare ideographs are letters, marks go with theirs."""
    none = ["\u3002\u3002\u3002", "\u00d7 \u00f7 \u00d7", "\u0661\u0662\u0663", "\u300c\u300d", "\U0001f600\U0001f680", "\u0301\u0302", "\u20ac 12.5", "\u2167", "", " ", None]
    some = ["\ufb01\ufb02", "\uff21\uff22\uff23", "\U00020000\U00020001", "e\u0301te\u0301", "\u1e9e", "\u00aa", "a\u0301", "\u0915\u093f\u0924\u093e\u092c", "\u02b0"]
    taught = [(i, w, lang) for i, (w, lang) in enumerate([("the house is on the hill and the road", "en"), ("das Haus steht auf dem Berg und die Strasse", "de"), ("\u0434\u043e\u043c \u0441\u0442\u043e\u0438\u0442 \u043d\u0430 \u0433\u043e\u0440\u0435", "ru")] * 4)]
    model = langid.learn(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    rows = list(enumerate(none + some))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, t in rows:
        alpha = any(c.isalpha() for c in t or "")
        assert (got[k].lang_pred != "und") == alpha == (got[k].score > 0) == (len(got[k].spans) > 0), t
    assert langid.identify(spark.createDataFrame([(1, "\u0433\u043e\u0440\u0430")], "doc_id long, text string"), model).first().lang_pred == "ru"


def test_characters_by_code_point():
    for c in [*range(0x20, 0x3000, 7), *range(0x3000, 0xD800, 101), *range(0xE000, 0x33000, 97)]:
        raw = np.frombuffer(f"a{chr(c)}1".encode(), np.uint8)
        kind = langid.characters(raw)
        assert len(set(kind[1:-1])) == 1 and (kind[1] >= langid._LETTERS) == chr(c).isalpha() and kind[0] == langid._LETTERS and kind[-1] == 0


def test_two_hundred_languages(spark):
    """Each language has words of its own; labels past the 127th are told apart."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    own = {f"l{k:03d}": ["".join(rng.choice(letters, 6)) for _ in range(12)] for k in range(200)}
    rows = [(i, " ".join(rng.choice(words, 40)), lang) for i, (lang, words) in enumerate(own.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = langid.identify(df, langid.learn(df)).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 195


def test_little_training_is_no_advantage(spark):
    """A language of one short document gets no text that it doesn't know better, neither of its script nor of another."""
    english = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang")
    strange = ["Straßenbahnhaltestelle Fußgängerüberweg Oberflächengestaltung", "Qwxzvkjq zzqxjvkw pqxzvjkq", "Krzysztof Szczepański Wrzeszcz", "Ünïcödé Àéîõü"]
    for few, text in (("ru", "привет мир"), ("de", "Rindfleisch und Kartoffeln"), ("aa", "xhosa zulu")):
        docs = english.union(spark.createDataFrame([(-1, text, few)], english.schema))
        model = langid.learn(docs)
        rows = [(i, t) for i, t in enumerate([*strange, text])]
        got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
        assert got[len(strange)] == few
        if few == "ru":
            assert all(got[i] == "en" for i in range(len(strange)))
        held = langid.identify(english, model).collect()
        assert sum(r.lang_pred == "en" for r in held) >= 0.99 * len(held)


def test_a_thousand_documents_against_one(spark):
    """Unseen words cost the same in a language of a thousand documents and in one of one."""
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    big, small = (["".join(rng.choice(letters, 7)) for _ in range(n)] for n in (400, 15))
    rows = [(i, " ".join(rng.choice(big, 60)), "big") for i in range(1000)] + [(1000, " ".join(small), "a_small")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    asked = [" ".join(rng.choice(big, 8)) for _ in range(50)] + [" ".join(rng.choice(small, 8)) for _ in range(50)]
    half = [" ".join([*rng.choice(big, 3), *("".join(rng.choice(letters, 9)) for _ in range(3))]) for _ in range(50)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(list(enumerate(asked + half)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(100)] == ["big"] * 50 + ["a_small"] * 50
    assert sum(got[i] == "big" for i in range(100, 150)) >= 45  # made-up words may have pieces of either by chance


def test_a_script_rules_languages_out():
    """Words of a script are scored in its languages only, those of a script without a language in all."""
    latin, cyrillic = langid.SCRIPT_NAMES.index("latin"), langid.SCRIPT_NAMES.index("cyrillic")
    allowed = np.zeros((3, len(langid.SCRIPT_NAMES)), bool)
    allowed[[0, 1], latin] = allowed[[1, 2], cyrillic] = True
    model = langid.Model(["a", "b", "c"], np.zeros((3, langid.BUCKETS), np.float32), allowed)
    raw = "word слово λόγος".encode()
    e, *_ = model.word_scores(Texts(0, 1, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert np.isfinite(e).tolist() == [[True, True, False], [False, True, True], [True, True, True]]


def test_mixed_text_has_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    a, b = (docs.filter(f"lang = '{x}' and n_chars between 800 and 1500").orderBy("doc_id").first().text for x in ("en", "de"))
    r = langid.identify(spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string"), model).first()
    assert {s.lang for s in r.spans} >= {"en", "de"} and len(r.spans) < 12


def test_urls(spark):
    page = lambda i, url, html="": (i, url, html, "x")
    link = '<html><link href="{0}" rel="canonical"></html>'
    rows = [
        page(1, "http://a.net/x", link.format("http://blocked.com/de/1")), page(2, "http://blocked.com/de/1"), page(3, "http://b.net/y", '<meta http-equiv="refresh" content="0; url=/z">'), page(4, "http://B.net/z", link.format("//ok.org/")),
        page(5, "http://c.net/", link.format("http://a.net/x#top")), page(6, None), page(7, "no scheme"), page(8, "http://ok.org/"), page(9, "http://d.net/", link.format("http://ok.org/")), page(9, "http://d.net/"), page(10, "http://d.net/q", link.format("http://blocked.com/de/2")), page(11, "http://d.net/p", link.format("http://d.net/q")), page(12, "http://plain.net"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = [(r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, registry.URL_RULES).orderBy("page_id").collect()]
    assert got == [(1, None, "block"), (2, "com/de/", "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "block"), (6, None, "allow"), (7, None, "allow"), (8, "org/", "allow"), (9, None, "allow"), (9, None, "allow"), (10, None, "block"), (11, None, "block"), (12, None, "allow")]


def test_links_resolve_like_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["http://a.net/x/y/z.html?q=1#f", "http://a.net", "https://b.org/d/"]
    links = ["w", "./w", "../w", "../../w", "../../../../w", "/r/./s/../t", "//o.net/p/q", "http://abs.net/a/b", "?k=2", "w/..", "w/.", "w/../", "..", "../", "a.b/..c/.d", "w?x=../y"]
    rows = [(b, k) for b in bases for k in links]
    got = spark.createDataFrame(rows, "base string, link string").select("base", "link", urlfilter.node(urlfilter.resolved(F.col("base"), F.col("link"))).alias("to")).collect()
    for r in got:
        want = urljoin(r.base, r.link)
        assert r.to.rstrip("/") == want.split("#")[0].rstrip("/"), (r.base, r.link, want)
    whole = spark.range(1).select(*(urlfilter.resolved(F.lit(bases[0]), F.lit(x)).alias(f"c{k}") for k, x in enumerate(("//o.net/p/../q", "http://abs.net/a/./../b?c=/../d"))))
    assert tuple(whole.first()) == ("http://o.net/q", "http://abs.net/b?c=/../d")


def test_pages_of_odd_rows(spark):
    """Null pages, very long ones, rows that repeat, clashing columns, a hub of aliases, and an empty table."""
    link = '<link rel="canonical" href="http://blocked.com/de/hub">'
    rows = [(i, f"http://n{i}.net/", "x" * (200_000 if i == 0 else 10) + link, None) for i in range(60)] + [(60, None, link, None), (61, "http://z.net/", None, None), (None, "http://z.org/", "", None), (3, "http://n3.net/", link, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string").withColumn("component", F.lit(1)).withColumn("node", F.lit("n"))
    got = sorted(((r.page_id, r.rule, r.verdict) for r in urlfilter.judge(df, registry.URL_RULES).collect()), key=str)
    want = [(i, None, "block") for i in [*range(60), 3]] + [(60, None, "allow"), (61, None, "allow"), (None, "org/", "allow")]
    assert got == sorted(want, key=str)
    assert urlfilter.judge(df.filter("page_id < 0"), registry.URL_RULES).count() == 0


def brute_repeats(rows):
    first, out = {}, []
    low = lambda d: -(2**63) if d is None else d
    for d in sorted({low(d) for d, _ in rows}):
        own = [(k, (t or "").encode()) for k, t in rows if low(k) == d]
        for i, b in own:
            gone = bytearray(len(b))
            for k in range(len(b) - 49):
                if b[k : k + 50] in first:
                    gone[k : k + 50] = b"\1" * 50
            n = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
            out.append((i, len(b), sum(gone), n, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
        for _, b in own:
            for k in range(len(b) - 49):
                first.setdefault(b[k : k + 50], d)
    return sorted(out, key=str)


def repeats(df, **options):
    return sorted((tuple(r) for r in suffixdedup.repeated_spans(df, **options).drop("spans").collect()), key=str)


#: Few and many groups, and one that lists representatives by chunk of blocks.
REPEAT_OPTIONS = [{}, {"hot_blocks": 0, "bucket_bytes": 20_000}, {"bucket_bytes": 5_000, "groups": 3, "hot_blocks": 1}]


@pytest.mark.parametrize("options", REPEAT_OPTIONS)
def test_repeats(hard, options):
    assert repeats(hard, **options) == brute_repeats(ROWS)


@pytest.mark.parametrize("options", REPEAT_OPTIONS[:1] + [{"bucket_bytes": 40_000, "groups": 5, "hot_blocks": 2}])
def test_repeats_of_documents(documents, options):
    assert repeats(documents.repartition(5), **options) == brute_repeats([(r.doc_id, r.text) for r in documents.collect()])


BIG = 2**60
ODD_REPEATS = {
    "short": [(1, "ab"), (2, "ab"), (3, "x" * 49)],
    "null and empty": [(1, None), (2, ""), (3, None)],
    "copies in other blocks": [(1, BASE), (2, BASE)],
    "no ids": [(None, BASE), (BIG + 1, BASE), (None, BASE), (BIG, "y " + BASE + " z"), (None, "only here " * 9)],
    "one id, other texts": [(1, BASE[:300]), (3, BASE[100:400] + " end"), (3, "quite unlike all that, " + LONG[:300]), (3, BASE[100:400] + " end"), (9, LONG[100:200])],
    "ends of the range": [(-(2**63), BASE), (2**63 - 1, BASE[:200]), (0, None)],
}


@pytest.mark.parametrize("name", ODD_REPEATS)
def test_repeats_of_odd_rows(spark, name):
    rows = ODD_REPEATS[name]
    for parts in (1, len(rows)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert repeats(df) == brute_repeats(rows), parts


def brute_cut(rows):
    """Texts without their repeated spans, for rows of single-byte characters."""
    out = []
    for k, (d, t) in enumerate(rows):
        less = [u.encode() for e, u in rows if u and (-(2**63) if e is None else e) < (-(2**63) if d is None else d)]
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if any(b[i : i + 50] in u for u in less):
                gone[i : i + 50] = [True] * 50
        out.append((k, d, None if t is None else bytes(c for c, g in zip(b, gone) if not g).decode()))
    return out


def test_repeats_are_cut(spark, hard, empty):
    out = suffixdedup.without_repeats(hard)
    assert out.columns == hard.columns and out.count() == len(ROWS)
    assert {r.text for r in out.filter("doc_id = 2").collect()} == {""}
    assert suffixdedup.repeated_spans(empty).count() == 0 and suffixdedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize("name", ODD_REPEATS)
def test_repeats_of_odd_rows_are_cut(spark, name):
    """Rows keep their other columns, whatever their names, and rows that share an id lose what is in their own text."""
    rows = ODD_REPEATS[name]
    df = spark.createDataFrame([(k, d, t, [k], "s") for k, (d, t) in enumerate(rows)], "_id long, doc_id long, text string, block array<int>, `spans` string").repartition(2)
    got = sorted((r._id, r.doc_id, r.text) for r in suffixdedup.without_repeats(df).collect())
    assert got == brute_cut(rows)
    assert all(r.block == [r._id] and r.spans == "s" for r in suffixdedup.without_repeats(df).collect())


def test_equal_hashes_of_other_bytes(spark, monkeypatch):
    """Contexts count as equal by their bytes; a hash that takes everything for equal changes nothing."""
    data = np.frombuffer(b"abcabdabc", np.uint8)
    assert suffixdedup._differ(data, np.array([0, 0, 3]), np.array([6, 3, 3]), np.array([3, 3, 3])).tolist() == [False, True, False]


@pytest.mark.parametrize("n,top", [(1, 1), (2, 2), (10, 3), (1000, 2), (1001, 4), (3002, 250)])
def test_difference_cover(n, top):
    s = np.random.default_rng(n).integers(1, top + 1, n)
    assert suffixdedup.suffix_array(s, top).tolist() == sorted(range(n), key=lambda i: s.tolist()[i:])
    assert decontam.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s.tolist()[i:])


def brute_contamination(rows, items, window=13):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 400}])
def test_contamination(spark, hard, options):
    items = [(1, "word30 word31"), (2, BASE), (3, None), (4, ""), (5, LONG[5000:5400]), (6, "ab"), (7, "not there")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.longest_matches(hard.dropDuplicates(["doc_id"]), bench, **options)
    got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}))) for r in found.collect())
    assert got == brute_contamination(dict(ROWS).items(), items)
    clean = decontam.decontaminate(hard, bench, **options)
    assert clean.columns == hard.columns and {1, 2, 7}.isdisjoint(r.doc_id for r in clean.collect())


def test_contamination_of_odd_rows(spark, empty):
    """Rows without an id, repeated rows, rows that share an id, clashing columns and a long item, in one pass and in several."""
    item = " ".join(f"b{i}" for i in range(3000))
    rows = [(None, item[40:400], 1), (None, "clean", 1), (3, "x " + item[500:900], 1), (3, "x " + item[500:900], 1), (3, "other words here", 1), (4, None, 1), (5, "", 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _bad int").withColumn("n_hit", F.lit("h")).withColumn("key", F.lit("k")).repartition(3)
    items = [(1, item), (2, "other"), (3, "not there " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    order = lambda r: tuple(str(x) for x in r)
    for options in ({}, {"pass_bytes": 300}, {"pass_bytes": 9000}):
        found = decontam.longest_matches(df, bench, **options)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}))) for r in found.collect()), key=order)
        assert got == sorted(brute_contamination([r[:2] for r in rows], items), key=order)
        clean = decontam.decontaminate(df, bench, **options)
        assert clean.columns == df.columns and sorted((r[:2] for r in clean.collect()), key=order) == sorted([(None, "clean"), (4, None), (5, ""), (None, None)], key=order)
    assert decontam.longest_matches(empty, bench).count() == decontam.decontaminate(empty, bench, pass_bytes=300).count() == 0


def shard_of(raw, hashes=None):
    raw = [x.encode() for x in raw]
    return decontam.sorted_shard(Texts(0, len(raw), np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)), hashes)


def brute_matches(docs, items, window):
    out = []
    for d, t in enumerate(docs):
        w = t.split()
        for i, q in enumerate(x.split() for x in items):
            n = min(window, len(q))
            windows = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)} if q else set()
            inside, far = np.zeros(len(w) + 1, bool), np.zeros(len(w) + 1, int)
            for p in range(len(w)):
                if tuple(w[p : p + n]) in windows:
                    inside[p : p + n] = True
                    for j in range(len(q)):
                        k = 0
                        while p + k < len(w) and j + k < len(q) and w[p + k] == q[j + k]:
                            k += 1
                        far[p] = max(far[p], k)
            edge = np.flatnonzero(np.diff(np.r_[False, inside]))
            out += [(d, i, int(a), int(b - a), int(far[a:b].max())) for a, b in zip(edge[::2], edge[1::2])]
    return sorted(out)


def test_matches_of_repetitive_texts():
    """Runs and their longest verbatim matches against every pair of places, in few and in many turns."""
    rng = np.random.default_rng(0)
    for _ in range(80):
        window, v = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        docs = [" ".join(f"w{x}" for x in rng.integers(0, v, rng.integers(0, 60))) for _ in range(4)]
        items = [" ".join(f"w{x}" for x in rng.integers(0, v, rng.integers(0, 20))) for _ in range(4)]
        test = decontam.TestWords(list(enumerate(items)), window)
        m = decontam.shard_matches(shard_of(docs, test.hashes), test, held=int(rng.choice([5, 50, 10**6])))
        assert list(zip(*(x.tolist() for x in m[2:]))) == brute_matches(docs, items, window)
        assert m.n_hit.tolist() == [len({k for x in brute_matches(docs, items, window) if x[0] == d for k in range(x[2], x[2] + x[3])}) for d in range(4)]


def test_one_word_over_and_over():
    """20,000 times one word against 10,000 times the same, many items of it and one-word items: work and memory of the text's size, not of all pairs."""
    import tracemalloc

    tracemalloc.start()
    test = decontam.TestWords([(1, "w " * 10_000), (2, "w"), *((k, "v w " * 5000) for k in range(3, 30))], 13)
    m = decontam.shard_matches(shard_of(["w " * 20_000, "w v " * 10_000], test.hashes), test)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m.n_hit.tolist() == [20_000, 20_000] and peak < 400 << 20
    first = [x.tolist() for x in (m.item[:2], m.start[:2], m.words[:2], m.longest[:2])]
    assert first == [[0, 1], [0, 0], [20_000, 20_000], [10_000, 1]]
    assert len(m.doc) == 2 + 10_000 + 27 and set(m.longest[-27:].tolist()) == {10_000}


def test_repetitive_benchmark(spark, tmp_path):
    rows = [(1, "w " * 3000), (2, "the cat the the cat " * 300), (3, "a b " * 900 + "w " * 40), (4, "nothing")]
    items = [(1, "w " * 500), (2, "the"), (3, "a b " * 60), (4, "cat the"), (5, "b")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"pass_bytes": 300}):
        found = decontam.longest_matches(df, bench, **options).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}))) for r in found) == brute_contamination(rows, items)


def test_empty_benchmark(spark, hard):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.longest_matches(hard, none).filter("n_hit > 0").count() == 0


def check_packing(df, texts_of, window=2048):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    ids_of = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts_of}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids_of)
    for d, got in pieces.items():
        ids, at = ids_of[d], 0
        copies = len([1 for r in got if r.start == 0])
        for r in sorted(got, key=lambda r: r.start)[::copies]:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        want[at] += 1
    return want


def test_packing(hard, empty, documents):
    once = [(d, t) for d, t in ROWS if d != 13]
    sizes = check_packing(packing.pack(hard.filter("doc_id <> 13")), once)
    assert all(n & (n - 1) == 0 for n in sizes)
    sizes = check_packing(packing.pack(documents.repartition(5)), [(r.doc_id, r.text) for r in documents.collect()])
    assert all(n & (n - 1) == 0 for n in sizes)
    assert packing.pack(empty).count() == 0


def test_packing_of_odd_rows(spark):
    """Rows without an id or that share one are packed each for itself, with columns of clashing names."""
    rows = [(None, "a b"), (None, "a b"), (3, None), (3, "c" * 9000), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("p")).withColumn("start", F.lit(1)).repartition(2)
    got = packing.pack(df).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert sum(r.start == 0 for r in got) == len(rows) and {r.doc_tokens for r in got if r.doc_id == 4} == {1}
    assert total[None] == 2 * next(r.doc_tokens for r in got if r.doc_id is None) and sum(total.values()) == sum(r.doc_tokens for r in got if r.start == 0)


def test_special_token_text(spark):
    df = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    check_packing(packing.pack(df), [(1, "a<|endoftext|>b")])


def test_licenses(spark, hard, empty):
    rows = [(i, text, name) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    rows += [(100, "Some text.\nReleased under the MIT license\nmore text here", "MIT"), (101, None, None), (102, "released under licence", None), (103, "Licensed under the\nApache License, Version 2.0.", "Apache-2.0")]
    got = {r.doc_id: r.license for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert got == {i: name for i, _, name in rows}
    assert licenses.licenses(hard).filter("license is not null").count() == 0 and licenses.licenses(empty).count() == 0


def dice(a, b):
    a, b = (Counter(licenses.template_bigrams(x)) for x in (a, b))
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_licenses_of_wrapped_and_odd_texts(spark):
    """Full texts in comments, wrapped over lines; a null id has its match; long texts, repeated rows and clashing columns."""
    import textwrap

    def comment(text, sign):
        return "\n".join(f"{sign} {line}" for line in textwrap.wrap(text, 60))

    mit, bsd = (next(t for n, t in reversed(licenses.TEMPLATES) if n == name) for name in ("MIT", "BSD-3-Clause"))
    code = "import os\n\ndef f(x):\n    return x\n"
    rows = [
        (1, "/*\n" + comment("Copyright (c) 2020 Some One", " *") + "\n *\n" + comment(mit, " *") + "\n */\n" + code, "MIT"),
        (2, comment(bsd, "#") + "\n#\n" + code, "BSD-3-Clause"),
        (None, "x\n\nReleased under the MIT License.\n", "MIT"),
        (4, code * 3000 + "\n--\n" + comment(mit, "//"), "MIT"),
        (5, "Released under the MIT License.", "MIT"), (5, "Released under the MIT License.", "MIT"),
        (6, mit[: len(mit) // 8], None), (7, "license software copyright warranty", None), (8, "\n\n\n", None),
    ]
    df = spark.createDataFrame([(i, t, n, "s") for i, t, n in rows], "doc_id long, text string, license string, segment string")
    got = [(r.doc_id, r.license) for r in licenses.licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(i, n) for i, _, n in rows], key=str)


def test_licenses_against_brute_force(spark):
    """Every template with words dropped and put in, against the Dice coefficient over all templates."""
    rng = np.random.default_rng(9)
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        for share in (0.05, 0.12, 0.2):
            kept = [w for w in words if rng.random() > share]
            rows.append((len(rows), " ".join(x for w in kept for x in ([w, "word"] if rng.random() < share / 4 else [w]))))
    got = {r.doc_id: (r.license, r.dice) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        score, name = min((-dice(t, text), name) for name, text in licenses.TEMPLATES)
        assert got[i] == ((name, pytest.approx(-score)) if -score >= licenses.THRESHOLD else (None, 0.0)), t


@pytest.mark.parametrize("name", ["op1_neardup", "op6_urls", "op7_repeats", "op8_decontamination", "op10_licenses"])
def test_against_sql(spark, name):
    from helpers import duck, duck_rows, spark_rows

    assert spark_rows(registry.queries()[name](spark, SF)) == duck_rows(duck(SF), registry.oracle_sql()[name])
