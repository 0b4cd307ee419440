"""Every stage of the pipeline on what the stage before it kept, against brute force."""

import inspect

import pytest
from test_corpus import brute_components, brute_contamination, brute_repeats, check_packing

import corpus_pipeline
from orrery.llm import decontam, quality, suffixdedup
from orrery.llm.common import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, SF), name)
        out.append((docs, new))
        docs = new
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_keeps_good_documents(spark, steps):
    before, after = steps[0]
    assert after.columns == before.columns
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {d for d, _ in rows(after)}
    wrong = [d for d, y in label.items() if (d in kept) != bool(y)]
    assert len(wrong) <= 0.02 * len(label)


def test_one_document_of_each_group_stays(steps):
    before, after = steps[1]
    want = {d for d, (_, c) in brute_components(rows(before), 5).items() if c == d}
    assert sorted(d for d, _ in rows(after)) == sorted(want) and after.columns == before.columns


def test_repeats_are_cut(steps):
    before, after = steps[2]
    gone = {d: n for d, _, n, _, _ in brute_repeats(rows(before))}
    old, new = dict(rows(before)), dict(rows(after))
    assert set(old) == set(new)
    for d, n in gone.items():
        left = len(old[d].encode()) - n
        assert left - 8 * (n > 0) * (1 + n // 50) <= len(new[d].encode()) <= left
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_contaminated_documents_go(spark, steps):
    before, after = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, n, hit, _ in brute_contamination(rows(before), items) if not (hit and 20 * hit >= n)}
    assert {d for d, _ in rows(after)} == want


def test_everything_is_packed(steps):
    before, after = steps[4]
    sizes = check_packing(after, rows(before))
    assert all(n & (n - 1) == 0 for n in sizes)


def test_rows_without_an_id_or_that_share_one(spark):
    """Two texts without an id and two that share one stay; copies, and of each only the contaminated text, go."""
    text = lambda a: " ".join(f"{a}{i}" for i in range(80))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("d")), (9, text("b")), (10, text("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.no_near_duplicates(spark, df, SF)
    key = lambda r: (r[0] or 0, r[1] or "")
    left = [(None, text("a")), (7, text("c")), (7, text("d")), (9, text("b")), (10, text("e"))]
    assert sorted(map(tuple, kept.collect()), key=key) == left
    bench = spark.createDataFrame([(1, text("a")), (2, text("c")), (3, "not there at all")], "item_id long, text string")
    for options in ({}, {"pass_bytes": 100}):
        assert decontam.longest_matches(df, bench, **options).count() == len(rows)
        clean = decontam.decontaminate(df, bench, **options)
        want = [r for r in rows if r[1] not in (text("a"), text("c"))]
        assert sorted(map(tuple, clean.collect()), key=key) == sorted(want, key=key)
    part = [(1, text("f")), (7, "x " + text("f") + " y"), (7, "zz " + text("g")), (None, text("h")), (12, "q " + text("h"))]
    cut = suffixdedup.without_repeats(spark.createDataFrame(part, "doc_id long, text string")).collect()
    assert sorted(map(tuple, cut), key=key) == [(None, text("h")), (1, text("f")), (7, "x  y"), (7, "zz " + text("g")), (12, "q ")]


def test_quality_stage_keeps_what_op3_calls_good(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {r.doc_id for r in quality.accepted(docs, model).collect()} == {d for d, x in score.items() if x >= 0.7}
    assert inspect.signature(quality.accepted).parameters["threshold"].default == quality.THRESHOLD == 0.7


def test_stages_take_odd_tables(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and columns of clashing names pass every stage; so does an empty table."""
    fine = "The keeper of the old mill walked along the river and counted the boats that came in with the tide. "
    long = " ".join(f"{fine[:-2]} {i}." for i in range(4000))
    rows = [
        (1, fine * 3, "en", "a", 1), (2, fine * 3, "en", "a", 1), (2, fine * 3, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n ", "en", "a", 3), (6, long, "en", "a", 1), (7, long + " tail", "en", None, 1),
        (None, fine * 2 + "Another end.", "en", "a", 1), (None, None, None, None, None), (8, "é" * 60, "fr", "b", 60), (8, "ü" * 60, "de", "b", 60),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int, _node long, _id string, _bad int, score double, spans string, content long, key string, component_id long, kept boolean"
    df = spark.createDataFrame([(*r, 1, "i", 2, 0.5, "s", 3, "k", 4, True) for r in rows], schema).repartition(3)
    key = lambda r: str(r)
    for docs in (df, df.filter("doc_id < 0")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = written(stage(spark, docs, SF), name)
            assert out.columns == df.columns, name
            got = sorted(((r.doc_id, r.text) for r in out.collect()), key=key)
            if name == "near_duplicates":
                assert got == sorted({(d, t) for d, t, *_ in rows if (d, t) in set(map(tuple, got))}, key=key)
                if docs is df:
                    assert {d for d, t in got if t == fine * 3} == {1} and {d for d, t in got if t and len(t) > 9000} == {6}
                    assert {(3, None), (4, ""), (None, None), (8, "é" * 60), (8, "ü" * 60)} <= set(got)
            elif name == "repeated_passages" and docs is df:
                # the row without an id comes first of all and keeps its text
                assert len(got) == len(rows) and (3, None) in got and (None, fine * 2 + "Another end.") in got and len(dict(got)[7]) < 100
            elif name == "decontamination":
                assert got == sorted(((r[0], r[1]) for r in rows), key=key) if docs is df else not got
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert sum(r.start == 0 for r in packed.collect()) == (len(rows) if docs is df else 0)
