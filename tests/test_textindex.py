"""The block-bounded text index against plain BM25 over every document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import retrieval as R
from orrery.operators import textindex as I

WORDS = [f"w{i}" for i in range(60)]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, 61)
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 40))
        rows.append((i, " ".join(rng.choice(WORDS, size, p=odds / odds.sum())) if size else None, [" ".join(rng.choice(WORDS, 3)) for _ in range(int(rng.integers(0, 3)))]))
    return rows


def tokens(t):
    return re.findall(r"\w+", (t or "").lower())


def plain(rows, queries, fields):
    """{query: {id: (score, fields)}}; fields: name to (place in a row, weight, operator)."""
    out = defaultdict(dict)
    for name, (at, weight, operator) in fields.items():
        units = [(r[0], tokens(t)) for r in rows for t in (r[at] if isinstance(r[at], list) else [r[at]]) if tokens(t)]
        mean = sum(len(t) for _, t in units) / len(units)
        df = Counter(w for _, t in units for w in set(t))
        for q, text in queries:
            wanted = set(tokens(text))
            for i, t in units:
                tf = Counter(t)
                met = wanted & set(tf)
                if not met or (operator == "and" and met != wanted):
                    continue
                s = sum(math.log(1 + (len(units) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in met)
                old = out[q].get(i, (0.0, set()))
                out[q][i] = (old[0] + weight * s, old[1] | {name})
    return out


def best(found, k):
    return {q: [(i, round(s, 6), sorted(f)) for i, (s, f) in sorted(hits.items(), key=lambda h: (-round(h[1][0], 9), h[0]))[:k]] for q, hits in found.items() if hits}


def told(leg):
    out = defaultdict(list)
    for r in sorted(leg.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.asset_id, round(r.score, 6), list(r.fields)))
    return dict(out)


QUERIES = [(1, "w0 w3 w50"), (2, "W1"), (3, "absent"), (4, ""), (5, "w2 w2 w7 w59 absent"), (6, None), (7, " ".join(WORDS))]


@pytest.mark.parametrize("k,size", [(1, 2_000_000), (7, 300), (5000, 300)])
def test_the_best_of_each_query(spark, monkeypatch, k, size):
    monkeypatch.setattr(I, "SEGMENT", size)
    rows = corpus(3000)
    docs = spark.createDataFrame(rows, "asset_id long, text string, tags array<string>").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    for fields, plan in (
        ({"text": (F.col("text"), 1.0, 0.0)}, {"text": (1, 1.0, "or")}),
        ({"text": R.Field(F.col("text"), 2.0, operator="and"), "tags": R.Field(F.col("tags"), 0.5, nested=True)}, {"text": (1, 2.0, "and"), "tags": (2, 0.5, "or")}),
        ({"a": R.Field(F.col("text"), 3.0), "b": R.Field(F.get("tags", 0), 1.0)}, {"a": (1, 3.0, "or"), "b": (3, 1.0, "or")}),
    ):
        data = [(*r, r[2][0] if r[2] else None) for r in rows]
        want = plain(data, [q for q in QUERIES if q[1]], plan)
        leg, sizes = R.text_top(docs, queries, fields, k)
        assert told(leg) == best(want, k)
        assert {r.query_id: r.n for r in sizes.collect()} == {q: len(h) for q, h in want.items() if h}
        whole = R.ranked(R.text_leg(docs, queries, fields)).filter(F.col("rank") <= k)
        assert told(whole) == best(want, k)


def test_blocks_are_passed_over(monkeypatch):
    """Of a rare strong word and a common weak one, most blocks aren't scored, and the best are the same."""
    import pyarrow as pa

    n = 40_000
    rng = np.random.default_rng(2)
    ids = np.arange(n, dtype=np.int64)
    strong = np.sort(rng.choice(n, 40, replace=False))
    tf = np.where(np.isin(ids, strong), 30, 1)
    rows_of = lambda m: (np.repeat(ids, m), np.zeros(m.sum(), np.int32), np.zeros(m.sum(), np.int32), np.repeat(np.full(n, 30), m))
    table = pa.Table.from_batches([I._lists(*rows_of(tf), pa.array(["common"] * int(tf.sum())))])
    asked = I.Asked(np.array([1]), np.array([0, 1]), np.array([0]), np.array([0]), ["common"], np.array([1.0]), np.array([1]))
    scored = []
    old = I._best
    monkeypatch.setattr(I, "_best", lambda i, s, k: (scored.append(len(i)), old(i, s, k))[1])
    ((_, got, score, _, total),) = I.best_of_segment(table, asked, [("or", False)], {0: 30.0}, 10, I.K1, I.B)
    assert got.tolist() == strong[:10].tolist() and total == n and sum(scored) < n / 4
    assert np.allclose(score, 30 * 2.2 / (30 + 1.2))


def test_a_stored_index(spark, tmp_path):
    """Built once, searched by many, documents added later; read again by another object."""
    rows = corpus(1200, 4)
    schema = "asset_id long, text string, tags array<string>"
    fields = {"text": R.Field(F.col("text"), 1.5)}
    index = I.TextIndex.build(spark.createDataFrame(rows[:700], schema).repartition(2), fields, f"file://{tmp_path}/index", size=4000)
    index.add(spark.createDataFrame(rows[700:], schema))
    again = I.TextIndex(spark, f"file://{tmp_path}/index", fields)
    want = plain(rows, [q for q in QUERIES if q[1]], {"text": (1, 1.5, "or")})
    for listed in (1000, 3):  # words by a list in the scan, and by a join
        I.LISTED, kept = listed, I.LISTED
        leg, sizes = again.search(spark.createDataFrame(QUERIES, "query_id long, text string"), 9)
        got = {q: [h[:2] for h in hits] for q, hits in told(leg.withColumn("fields", F.array().cast("array<string>"))).items()}
        assert got == {q: [h[:2] for h in hits] for q, hits in best(want, 9).items()}
        assert {r.query_id: r.n for r in sizes.collect()} == {q: len(h) for q, h in want.items() if h}
        I.LISTED = kept
    plan = again.rows(["w1", "w2"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(word" in plan


def test_many_queries_in_turns(spark):
    docs = spark.createDataFrame(corpus(200, 5), "asset_id long, text string, tags array<string>")
    queries = spark.createDataFrame([(i, f"w{i % 60} w{i % 7}") for i in range(300)], "query_id long, text string")
    found = R.field_tokens(docs, R.Field(F.col("text")))
    terms = R.written(R.query_terms(queries).select("query_id", F.lit(0).alias("field"), "term", F.col("term").alias("word"), F.lit(1.0).alias("weight")), "t")
    stored = R.written(R.segments(found, terms.select("word")), "p")
    one, many = ({(r.query_id, r.asset_id, r.n, r.score and round(r.score, 9)) for r in R.search(stored, terms, [("or", False)], 5, most_terms=m).collect()} for m in (10**6, 50))
    assert one == many and len(one) > 1000


def test_empty_corpus_and_no_queries(spark):
    docs = spark.createDataFrame(corpus(20), "asset_id long, text string, tags array<string>")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    for d, q in ((docs.filter("asset_id < 0"), queries), (docs, queries.filter("query_id < 0")), (docs.filter("text is null"), queries)):
        leg, sizes = R.text_top(d, q, {"text": (F.col("text"), 1.0, 0.0)}, 5)
        assert leg.collect() == [] and sizes.collect() == []


def test_wildcards_of_long_texts_and_by_case(spark):
    docs = spark.createDataFrame([(1, "The Quick fox"), (2, "the quick FOX"), (3, None), (4, ""), (5, "x" * 100_000 + "Quick"), (6, "qu"), (7, "日本語 quick \n fox")], "asset_id long, text string")
    queries = spark.createDataFrame([(1, "Quick"), (2, "qu"), (3, "k F"), (4, "本"), (5, "quick \n f"), (6, " ")], "query_id long, text string")
    rows = {r.asset_id: r.text for r in docs.collect() if r.text}
    for case in (True, False):
        got = {(r.query_id, r.asset_id) for r in R.text_leg(docs, queries, {"t": R.Field(F.col("text"), 0.0, 1.0, case_sensitive=case)}).collect()}
        low = (lambda s: s) if case else str.lower
        assert got == {(q.query_id, i) for q in queries.collect() if q.text.strip() for i, t in rows.items() if low(q.text) in low(t)}


def test_generated_metadata_as_fields(spark):
    """One nested field per plugin over its value texts, elements summed; labels of entries don't match."""
    entry = "array<struct<name:string,value_text:array<string>,value_bool:boolean>>"
    rows = [(1, {"caption": [("colors", ["red", "dark red"], None)], "tags": [("red", ["blue"], True)]}), (2, {"tags": [("mood", ["red"], None)]}), (3, None), (4, {"caption": []})]
    docs = spark.createDataFrame(rows, f"asset_id long, vlm map<string,{entry}>")
    fields = R.metadata_fields(docs, "vlm", R.Field(F.lit(None), 2.0))
    assert list(fields) == ["vlm.caption.value_text", "vlm.tags.value_text"] and all(f.nested and f.match == 2.0 for f in fields.values())
    got = {r.asset_id: list(r.fields) for r in R.text_leg(docs, spark.createDataFrame([(1, "red")], "query_id long, text string"), fields).collect()}
    assert got == {1: ["vlm.caption.value_text"], 2: ["vlm.tags.value_text"]}
    assert R.metadata_fields(docs.filter("asset_id = 3"), "vlm", R.Field(F.lit(None))) == {}


@pytest.mark.parametrize("kind", ["exact", "phrase", "prefix"])
def test_match_types_of_many_queries(spark, kind):
    """A table of queries against the expression for one query, over every text."""
    rng = np.random.default_rng(3)
    some = ["red", "redwood", "re", "wall", "waller", "w", "stone", "ü", "漢字", "a_b"]
    rows = [(i, " ".join(rng.choice(some, rng.integers(1, 12))).title() if i % 2 else " - ".join(rng.choice(some, 3))) for i in range(60)] + [(90, None), (91, ""), (92, "...")]
    queries = [(i, " ".join(rng.choice(some, rng.integers(1, 4)))) for i in range(60)] + [(80, ""), (81, None), (82, "red red"), (83, "RED, wal"), (84, "ston"), (85, "漢"), (86, "wa")]
    docs, asked = spark.createDataFrame(rows, "asset_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = [(r.query_id, r.asset_id) for r in R.field_matches(docs, asked, F.col("text"), kind).collect()]
    found = docs.select("asset_id", *(F.coalesce(R.field_match(F.col("text"), t, kind), F.lit(False)).alias(f"q{i}") for i, t in queries if t)).collect()
    want = {(i, r.asset_id) for i, t in queries if t for r in found if r[f"q{i}"]}
    assert len(got) == len(set(got)) and set(got) == want and want
    with pytest.raises(ValueError):
        R.field_matches(docs, asked, F.col("text"), "fuzzy")


def test_a_task_holds_counts_and_passes_hits_on_in_pieces(spark, monkeypatch):
    """Repeated words of a text are one posting, also across batches; a segment's hits of many queries leave in batches of bounded size."""
    import pyarrow as pa

    texts = [(i, ["same"] * 50 + [f"w{i % 7}"]) for i in range(400)]
    rows = [(i, 0, 0, len(t), w) for i, t in texts for w in [*t, I.MARK]]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["asset_id", "field", "element", "length", "word"])
    parts = [*I._cut("asset_id", 600)(iter(table.to_batches(max_chunksize=37)))]
    found = pa.Table.from_batches(parts).to_pylist()
    assert len(parts) == 3 and sum(r["n"] for r in found if r["word"] == "same") == 400  # 1,200 postings of 20,800 occurrences
    assert {t for r in found if r["word"] == "same" for t in np.frombuffer(r["tf"], np.int32)} == {50}
    assert sum(np.frombuffer(r["tf"], np.int32).sum() for r in found if r["word"] not in ("same", I.MARK)) == 400

    monkeypatch.setattr(I, "HELD_HITS", 100)
    docs = len(np.frombuffer(next(r["docs"] for r in parts[0].to_pylist() if r["field"] < 0), np.int64))
    queries = np.arange(30)
    asked = I.Asked(queries, np.arange(31), np.zeros(30, int), np.zeros(30, int), ["same"] * 30, np.ones(30), np.ones(30, int))
    shared = type("Shared", (), {"value": asked})
    out = [*I._task(shared, [("or", False)], {0: 51.0}, None, I.K1, I.B, "asset_id")(iter([parts[0]]))]
    assert len(out) == 30 and max(b.num_rows for b in out) <= 100 + docs + 1
    assert sum(b.num_rows for b in out) == 30 * (docs + 1)


def test_memory_of_building_segments_does_not_grow():
    """A task that reads three times the texts holds no more of them."""
    import tracemalloc

    import pyarrow as pa

    def batches(texts):
        words = pa.array([*WORDS[:24], I.MARK] * 400)
        for a in range(0, texts, 400):
            ids = np.repeat(np.arange(a, a + 400), 25)
            none = np.zeros(len(ids), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(none), pa.array(none), pa.array(none + 24), words], ["asset_id", "field", "element", "length", "word"])

    def peak(texts):
        tracemalloc.start()
        try:
            found = sum(r["n"] for part in I._cut("asset_id", I.SEGMENT)(batches(texts)) for r in part.select(["word", "n"]).to_pylist() if r["word"] == "w3")
            assert found == texts
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    less, more = peak(20_000), peak(60_000)  # 500,000 and 1,500,000 postings
    assert more < 1.2 * less and more < 50e6


@pytest.mark.parametrize("k,size", [(1, 2_000_000), (7, 300)])
def test_collapsed_in_segments(spark, monkeypatch, k, size):
    """The best of each hash and the number of hashes, with hashes of one text, of other texts, over many segments, and none."""
    monkeypatch.setattr(I, "SEGMENT", size)
    rows = corpus(400, 6)
    rows += [(i, rows[i % 50][1], rows[i % 50][2]) for i in range(400, 500)]
    name = lambda i: None if i % 11 == 0 else "big" if i % 5 < 2 else f"same{i % 50}" if i >= 400 else f"h{i % 150}"
    docs = spark.createDataFrame([(*r, name(r[0])) for r in rows], "asset_id long, text string, tags array<string>, hash_value string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    for fields, plan in (
        ({"text": (F.col("text"), 1.0, 0.0)}, {"text": (1, 1.0, "or")}),
        ({"text": R.Field(F.col("text"), 2.0, operator="and"), "tags": R.Field(F.col("tags"), 0.5, nested=True)}, {"text": (1, 2.0, "and"), "tags": (2, 0.5, "or")}),
    ):
        want = {}
        for q, hits in plain(rows, [q for q in QUERIES if q[1]], plan).items():
            first = {}
            for i, h in sorted(hits.items(), key=lambda h: (-round(h[1][0], 9), h[0])):
                first.setdefault(name(i) or i, (i, h))
            want[q] = dict(first.values())
        for most in (I.MOST_TERMS, 5):  # words by a broadcast, and by a shuffle
            monkeypatch.setattr(I, "MOST_TERMS", most)
            leg, sizes = R.text_collapsed(docs, queries, fields, k)
            assert told(leg) == best(want, k)
            assert {r.query_id: r.n for r in sizes.collect()} == {q: len(h) for q, h in want.items() if h}
        monkeypatch.undo()
        monkeypatch.setattr(I, "SEGMENT", size)


def test_a_collapsed_search_writes_no_hits_but_the_best(spark, monkeypatch):
    rows = [(i, f"red {'blue' if i % 2 else 'green'} w{i}", f"h{i % 1500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "asset_id long, text string, hash_value string").repartition(2)
    views = spark.createDataFrame([(1, 0, [1.0, 0.0])], "asset_id long, view_offset int, embedding array<double>")
    queries = spark.createDataFrame([(q, "red", None) for q in range(20)], "query_id long, text string, vector array<double>")
    wrote, old = {}, R.written
    monkeypatch.setattr(R, "written", lambda df, name="table": wrote.setdefault(name, old(df, name)))
    page = R.hybrid_search(docs, views, queries, collapse=True, size=5).collect()
    assert len(page) == 100 and {r.corpus_total for r in page} == {1500}
    assert "text-leg" not in wrote and wrote["hits"].count() <= 20 * 103 * max(wrote["postings"].filter("field = -1").count(), 1) < 60_000


@pytest.mark.parametrize("k", [25, 100, None])
def test_memory_of_searching_segments_does_not_grow(k):
    """A task that builds and searches three times the segments for 60 queries holds no more of them."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    queries = np.arange(60)
    asked = I.Asked(queries, np.arange(0, 241, 4), np.zeros(240, int), np.tile(np.arange(4), 60), [WORDS[i % 24] for i in range(240)], np.ones(240), np.full(240, 4))
    search = I._task(type("Shared", (), {"value": asked}), [("or", False)], {0: 24.0}, k, I.K1, I.B, "asset_id")

    def batches(texts):
        words = pa.array([*WORDS[:24], I.MARK] * 400)
        for a in range(0, texts, 400):
            ids = np.repeat(np.arange(a, a + 400), 25)
            none = np.zeros(len(ids), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(none), pa.array(none), pa.array(none + 24), words], ["asset_id", "field", "element", "length", "word"])

    def peak(texts):
        tracemalloc.start()
        try:
            hits = [(b.num_rows - b.column("n").null_count, b.column("n").null_count, pc.sum(b.column("n")).as_py()) for part in I._cut("asset_id", I.SEGMENT)(batches(texts)) for b in search(iter([part]))]
            counts, found, matching = (sum(c) for c in zip(*hits))
            assert matching == 60 * texts and found == (counts * k if k else matching)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    less, more = peak(20_000), peak(60_000)  # 500,000 and 1,500,000 postings
    assert more < 1.2 * less and more < 50e6
