"""Semantic traps on hand-made rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orrery.functions import exprs as E
from orrery.operators import evaluation as V
from orrery.operators import graph as G
from orrery.operators import predicates as P
from orrery.operators import prims as Q
from orrery.operators import retrieval as R
from orrery.sources import ingest as I
from orrery.streaming import jobs as J


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_ranges_are_inclusive_and_prim_dimensions_strict(spark):
    df = spark.createDataFrame([(1024,), (2048,)], "size long")
    assert df.filter(P.size_range(F.col("size"), "1KB", "1KB")).count() == 1
    prim = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)], "min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, scene_mpu double")
    dims = Q.with_dimensions(prim)
    assert dims.filter(Q.dimension_filter({"x": 1.0})).count() == 0
    assert dims.filter(P.dimension_range(F.col("scaled_x"), 1.0, 1.0)).count() == 1


def test_date_only_upper_bound_holds_the_day(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 23:59:59' AS t UNION ALL SELECT timestamp'2024-01-03 00:00:00'")
    assert df.filter(P.date_range(F.col("t"), before="2024-01-02")).count() == 1


def test_cut_hits_keep_ranks_and_ties_keep_leg_order(spark):
    leg = spark.createDataFrame([(1, 10, 3.0), (1, 11, 2.0), (1, 12, 1.0)], "query_id long, asset_id long, score double")
    assert [r.rank for r in R.cutoff(R.ranked(leg), 2.5).collect()] == [1]
    other = spark.createDataFrame([(1, 20, 9.0)], leg.schema)
    fused = R.rrf_fuse([("a", R.ranked(leg), 1.0), ("b", R.ranked(other), 1.0)]).orderBy("rank").collect()
    assert [r.asset_id for r in fused] == [10, 20, 11, 12]


def test_legs_of_one_name_all_score(spark):
    leg = R.ranked(spark.createDataFrame([(1, 10, 3.0)], "query_id long, asset_id long, score double"))
    r = R.explain_scores(R.rrf_fuse([("image", leg, 1.0), ("image", leg, 1.0)])).first()
    assert r.rrf_score == pytest.approx(2 / 61) and r.original_ranks == {"image": 1} and len(r.explanations) == 2


def test_dedup_keeps_rows_without_vectors_and_zero_vectors(spark):
    hits = spark.createDataFrame([(1, a, a) for a in range(1, 6)], "query_id long, asset_id long, rank int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0]), (5, [0.0, 1.0])], "asset_id long, vector array<double>")
    assert sorted(r.asset_id for r in R.similarity_dedup(hits, v, 0.1).collect()) == [1, 3, 4, 5]
    assert R.similarity_dedup(hits, v, 0).count() == 5


def test_collapse_leaves_null_hashes(spark):
    leg = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 2.0, None), (1, 3, 1.0, "h"), (1, 4, 2.0, "h")], "query_id long, asset_id long, score double, hash_value string")
    assert sorted(r.asset_id for r in R.collapse_by_hash(leg).collect()) == [1, 2, 4]


def test_property_lists(spark):
    props = spark.createDataFrame([([("a", "x,y", None), ("n", "4", 4.0)],), ([("a", "z", None), ("b", "x,y", None)],)], "props array<struct<name:string,value:string,value_numeric:double>>")
    assert props.filter(P.properties_all(F.col("props"), '"a=x,y",bare')).count() == 1
    assert props.filter(P.properties_numeric(F.col("props"), "n>3.5")).count() == 1
    with pytest.raises(ValueError):
        P.properties_numeric(F.col("props"), "n~4")


def test_regexps(spark):
    with pytest.raises(ValueError):
        P.url_regexp(F.col("x"), "a&b")
    df = spark.createDataFrame([("usd://abc",)], "x string")
    assert df.filter(P.url_regexp(F.col("x"), "abc")).count() == 0
    assert I.include_exclude(df, ["usd"], [], "x").count() == 1


def test_prim_properties(spark):
    df = spark.createDataFrame([({"n": "5", "s": "true"}, {"n": 5.0})], "properties map<string,string>, numbers map<string,double>")
    for good in ("n>4.5", "n=5", "s=True", "s=~tr.*", "n>=5,n<=5"):
        assert df.filter(Q.property_filter(good)).count() == 1, good
    for bad in ("n<5", "s=~tr", "missing=1"):
        assert df.filter(Q.property_filter(bad)).count() == 0, bad


def test_infinite_boxes_stay_out(spark):
    inf = float("inf")
    p = spark.createDataFrame([("s", "/a", 0.0, 0.0, 0.0), ("s", "/b", 0.5, 0.0, 0.0), ("s", "/i", inf, 0.0, 0.0)], "scene_url string, usd_path string, mid_x double, mid_y double, mid_z double")
    near = Q.near_prims(p, spark.createDataFrame([("s", "/a")], "scene_url string, centre_path string"), 1.0)
    assert sorted(r.usd_path for r in near.collect()) == ["/a", "/b"]


def test_empty_closure_keeps_nothing_and_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("z",)], "root string")
    assert {(r.root, r.node, r.level) for r in G.dependency_levels(e, roots).collect()} == {("a", "a", 0), ("a", "b", 1), ("z", "z", 0)}
    assert {(r.root, r.node) for r in G.dependencies_flat(e, roots).collect()} == {("a", "b")}


def test_archive_names_that_meet_get_numbers(spark):
    e = spark.createDataFrame([("s3://b/r.usd", "s3://b/../x/t.png"), ("s3://b/r.usd", "s3://b/_/x/t.png")], "src string, dst string")
    assets = spark.createDataFrame([(u, 1, False) for u in ("s3://b/r.usd", "s3://b/../x/t.png", "s3://b/_/x/t.png")], "url string, size long, deleted boolean")
    m = G.bundle_manifest(e, assets, spark.createDataFrame([("s3://b/r.usd",)], "root string"), assets.select("url"))
    paths = [r.archive_path for r in m.collect()]
    assert len(set(paths)) == 3 and sum("t_1.png" in p for p in paths) == 1


def test_change_log_and_retries(spark):
    rows = [(1, "u", "create", "h"), (2, "u", "create", "h"), (3, "u", "delete", None), (4, "u", "delete", None), (5, "u", "create", "h")]
    log = spark.createDataFrame(rows, "seq long, uri string, event string, hash_value string")
    assert [(r.seq, r.action) for r in J.changed_only_batch(log).orderBy("seq").collect()] == [(1, "upsert"), (3, "delete"), (5, "upsert")]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("c", 1, "k", 7, 2), ("c", 2, "k", 9, 1)], "config_id string, query_id long, query_class string, asset_id long, rank int")
    qrels = spark.createDataFrame([(1, 7, 1), (1, 8, 1)], "query_id long, asset_id long, grade int")
    m = V.retrieval_metrics(run, qrels).first()
    assert (m.queries, m.recall, m.mrr) == (1, 0.5, 0.5)
    assert m.ndcg == pytest.approx((1 / 1.5849625) / (1 + 1 / 1.5849625), abs=1e-6)


def test_functions(spark):
    assert one(spark, E.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 2.0
    assert one(spark, E.detect_numeric(F.lit("1e999"))) is None and one(spark, E.detect_numeric(F.lit("nan"))) is None
    assert one(spark, E.normalize_url(F.lit("s3://b/a/c.usd"), F.lit("..\\t\\x.png"))) == "s3://b/t/x.png"
    assert [x.prob for x in one(spark, E.parse_label_string(F.lit("cat (95%), dog")))] == [0.95, 1.0]
    assert one(spark, E.slug(F.lit("bigRed--Box"))) == "big_red_box"


def test_text_leg_of_large_item_ids(spark, tmp_path):
    from helpers import duck, duck_rows, spark_rows

    from orrery.plans import catalog

    small = Path("/root/testdata/sf0.001")
    for table in small.iterdir():
        if table.name != "benchmark.parquet":
            (tmp_path / table.name).symlink_to(table)
    items = spark.read.parquet(str(small / "benchmark.parquet"))
    items.withColumn("item_id", (F.col("item_id") + 990).cast(items.schema["item_id"].dataType)).toPandas().to_parquet(tmp_path / "benchmark.parquet")
    got = catalog.queries()["r01_text_leg"](spark, str(tmp_path))
    assert got.filter("query_id > 1002").count() > 0
    assert spark_rows(got) == duck_rows(duck(str(tmp_path)), catalog.oracle_sql()["r01_text_leg"])


def test_batched_vectors_with_many_views_of_one_asset(spark):
    views = [(1, v, [1.0 - v / 1e6, 0.0]) for v in range(100)] + [(a, 0, [0.9 - 0.01 * (a // 2), 0.5]) for a in range(40, 1, -1)]
    df = spark.createDataFrame(views, "asset_id long, view_offset int, embedding array<double>").coalesce(1)
    got = R.ranked(R.vector_scores_batched(df, [(7, [1.0, 0.0])], 20)).filter("rank <= 20")
    want = R.ranked(R.vector_scores(df, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<double>"))).filter("rank <= 20")
    rows = lambda leg: [(r.asset_id, round(r.score, 9), r.view_offset) for r in leg.orderBy("rank").collect()]
    assert rows(got) == rows(want) and len(rows(got)) == 20


def test_strings_and_maps(spark):
    assert one(spark, E.percentage_string(F.lit(1), F.lit(3))) == "33.33%"
    assert one(spark, E.percentage_string(F.lit(5), F.lit(0))).endswith("%") and one(spark, E.percentage_string(F.lit(None).cast("int"), F.lit(3))) is None
    m = lambda **kw: F.create_map(*(F.lit(x) for p in kw.items() for x in p))
    assert one(spark, E.combine_maps(m(a="x", b="y"), m(b="z", c="w"))) == {"a": "x", "b": "y, z", "c": "w"}
    assert one(spark, E.combine_maps(F.lit(None).cast("map<string,string>"), m(a="x"))) == {"a": "x"}


def test_late_changes_stay_behind_a_delete(spark):
    t = J.KeyedTable(spark, "uri string, seq long, hash_value string", "uri", "seq", parts=3)
    change = lambda *rows: spark.createDataFrame(list(rows), "uri string, seq long, hash_value string, event string")
    t.merge(change(("a", 1, "h1", "create"), ("b", 1, "h2", "create"), (None, 1, "h", "create")))
    t.merge(change(("a", 10, None, "delete")))
    t.merge(change(("a", 5, "late", "create"), ("b", 0, "late", "create")))
    assert [tuple(r) for r in t.read().collect()] == [("b", 1, "h2")]
    before = dict(t.folders)
    t.merge(change(("a", 11, "back", "create")))
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", 11, "back"), ("b", 1, "h2")]
    assert sum(t.folders[p] != f for p, f in before.items()) == 1  # only the part of that key is written again
    t.merge(change())
    assert t.read().count() == 2


@pytest.mark.parametrize("width", [16, 64, 100])
def test_recall_of_approximate_vectors(spark, width):
    """R6 over vectors of any width: near neighbours around centres, recall at 10 against exact scores."""
    import numpy as np

    rng = np.random.default_rng(width)
    x = rng.normal(size=(40, width))[rng.integers(0, 40, 1200)] + 0.35 * rng.normal(size=(1200, width))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    views = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)] + [(5000, 0, [1.0])], "asset_id long, view_offset int, embedding array<double>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1200, 60)], "query_id long, vector array<double>")
    got = R.ranked(R.vector_candidates(views, q)).filter("rank <= 10").collect()
    assert len(got) == 200
    hits = 0
    for i in range(0, 1200, 60):
        want = set(np.argsort(-(x @ x[i]), kind="stable")[:10].tolist())
        hits += len(want & {r.asset_id for r in got if r.query_id == i})
    print(f"recall at width {width}: {hits / 200}")
    assert hits >= 0.9 * 200
    mixed = q.unionByName(spark.createDataFrame([(9999, [1.0])], q.schema))
    top = R.vector_top(views, mixed, 10)
    assert top.filter("query_id = 9999").first().asset_id == 5000 and top.filter("query_id = 0").count() == 10


def test_text_clauses(spark):
    docs = spark.createDataFrame([(1, "red stone wall", ["red", "old stone"]), (2, "red", ["stone", "stone red"]), (3, "wall", []), (4, None, None), (5, "rad stone", ["x"])], "asset_id long, text string, notes array<string>")
    q = spark.createDataFrame([(7, "red stone")], "query_id long, text string")
    leg = lambda **kw: {r.asset_id: r for r in R.text_leg(docs, q, {"f": R.Field(**kw)}).collect()}
    assert set(leg(text=F.col("text"))) == {1, 2, 5} and set(leg(text=F.col("text"), operator="and")) == {1}
    near = leg(text=F.col("text"), operator="and", fuzzy=1)
    assert set(near) == {1, 5}
    nested = leg(text=F.col("notes"), nested=True)
    assert set(nested) == {1, 2} and set(leg(text=F.col("notes"), nested=True, operator="and")) == {2}
    assert set(leg(text=F.col("text"), match=0, wildcard=1.0)) == {1}
    for text, want in (("E", {1, 2, 5}), ("ST", {1, 5}), ("", set()), ("nothing", set())):
        short = spark.createDataFrame([(7, text)], q.schema)
        assert {r.asset_id for r in R.text_leg(docs, short, {"f": (F.col("text"), 0.0, 1.0)}).collect()} == want, text


def test_texts_that_hold_others(spark):
    docs = spark.createDataFrame([(1, "say the long word here"), (2, "thelong word"), (3, None), (4, "ab")], "asset_id long, text string")
    items = spark.createDataFrame([(1, "the long word"), (2, "e lo"), (3, "b"), (4, "long word"), (5, None), (6, "lon"), (7, "y the long w")], "query_id long, q string")
    want = {(i.query_id, r.asset_id) for r in docs.collect() for i in items.collect() if r.text and i.q and i.q in r.text}
    assert {tuple(r) for r in V.holding(docs, items).collect()} == want


def split_events(spark, folder, parts):
    """The events in files of consecutive sequence numbers."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by("event_id")
    n = -(-t.num_rows // parts)
    return [(f"{folder}/e{k}.parquet", t.slice(k * n, n)) for k in range(parts)]


def test_streams_over_batches_and_a_restart(spark, tmp_path):
    """Files that come one micro-batch each, with a restart in the middle, give what one look at everything does."""
    import pyarrow.parquet as pq

    from orrery.plans import indexing
    from orrery.sources import fixtures as X

    (tmp_path / "in").mkdir()
    files = split_events(spark, tmp_path / "in", 4)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    log = X.changes(spark, "/root/testdata/sf0.001").select("seq", "uri", "event", "hash_value")
    stream = lambda: X._change(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    out, table = {name: [] for name in ("z1", "z7", "z8")}, J.KeyedTable(spark, "uri string, seq long, hash_value string", "uri", "seq")
    jobs = {
        "z1": lambda s: J.changed_only(s),
        "z7": lambda s: J.retry_limit(s.filter("event <> 'delete'").withColumn("hash_value", F.lit("same"))),
        "z8": lambda s: J.status_history(s.select("uri", "seq", F.col("event").alias("status"))),
    }
    old = {k: spark.conf.get(k, None) for k in indexing._STATE}
    batches = set()
    try:
        for k, v in indexing._STATE.items():
            spark.conf.set(k, v)
        for some in (files[:2], files[2:]):  # what is there by then; the second run goes on from the first one's checkpoint
            for path, rows in some:
                pq.write_table(rows, path)
            for name, job in jobs.items():
                def each(df, n, name=name):
                    out[name] += [(n, *r) for r in df.collect()]
                    batches.add((name, n))
                J.run_available(job(stream()), each=each, mode="update" if name == "z8" else "append", checkpoint=f"{tmp_path}/{name}")
            J.run_available(stream().select("uri", "seq", "hash_value", "event"), each=lambda df, n: table.merge(df), checkpoint=f"{tmp_path}/s4")
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all({n for m, n in batches if m == name} >= {0, 1, 2, 3} for name in jobs)
    want = sorted(tuple(r) for r in J.changed_only_batch(log).select("uri", "seq", "action", "hash_value").collect())
    assert sorted(r[1:] for r in out["z1"]) == want
    by = {}
    for r in log.orderBy("seq").collect():
        by.setdefault(r.uri, []).append(r)
    tries = {u: [r.seq for r in rows if r.event != "delete"] for u, rows in by.items()}
    assert sorted(r[1:4] for r in out["z7"]) == sorted((u, s, "retry" if k < J.RETRIES else J.EXHAUSTED) for u, seqs in tries.items() for k, s in enumerate(seqs[: J.RETRIES + 1]))
    last = {}
    for n, uri, seq, status in out["z8"]:
        last.setdefault(uri, {}).setdefault(n, []).append((seq, status))
    assert {u: sorted(b[max(b)]) for u, b in last.items()} == {u: [(r.seq, r.event) for r in rows[-J.HISTORY :]] for u, rows in by.items()}
    assert sorted(tuple(r) for r in table.read().collect()) == sorted((u, rows[-1].seq, rows[-1].hash_value) for u, rows in by.items() if rows[-1].event != "delete")


def test_tables_of_settings_are_checked_before_they_are_broadcast(spark):
    from orrery.operators import stats as A
    from orrery.sources.tables import dimension

    assert dimension(spark.range(10), 10).count() == 10
    with pytest.raises(ValueError, match="more than 10 rows"):
        dimension(spark.range(11), 10)
    many = spark.range(10_001).select(F.concat(F.lit("p"), "id").alias("name"), F.lit(True).alias("active"), F.array(F.lit("usd"), F.lit("usd"), F.lit(None)).alias("data_types"))
    listing = spark.createDataFrame([("/a.usd", "create", "h"), ("/b", "create", "h"), ("/c.usd", "delete", "h")], "uri string, event string, hash_value string")
    done = spark.createDataFrame([("p7", "/a.usd", "h")], "plugin string, uri string, hash_value string")
    assert J.fan_out(listing, many, done).count() == 10_000  # an equi-join needs no bound
    with pytest.raises(ValueError, match="settings"):
        J.sync_status(listing, done, many)
    with pytest.raises(ValueError, match="settings"):
        A.assets_by_status(listing, many, done)


def test_thumbnails_by_pattern_joins_by_name(spark):
    """Names told by the files give the rows of the folder's comparison, also for odd names and patterns; a folder's assets don't meet all its files."""
    import re

    from orrery.operators import lookups as L

    assert [L._names_at_segments(p) for p in (r".*/\.thumbs/{name}\.\d\.png", r".*{name}", r"x/[{name}]", r"(?i){name}", r"{name}?", r"a|{name}", r"(/{name})?.*", r"[/|(]{name}", r".*")] == [True, False, None, None, None, None, None, False, None]
    names = ["a.png", "a", "", "b(1).usd", "\\E.usd", "ä", "aa", "a.png.1"]
    keys = [f"s3://b/d{k}/{n}" for k in (1, 2) for n in names]
    uris = [f"s3://b/d{k}/{t}" for k in (1, 2) for n in names for t in (f".thumbs/{n}.7.png", f".thumbs/x_{n}_x", n, f".thumbs/{n.upper()}.7.png")]
    assets, listing = spark.createDataFrame([(k,) for k in keys], "base_key string"), spark.createDataFrame([(u,) for u in uris], "uri string")
    folder = lambda u: re.sub(r"/$", "", re.sub(r"/\.thumbs/.*$|/[^/]*$", "", u))
    for pattern in (r".*/\.thumbs/{name}\.\d\.png", r".*/x_{name}_x", r".*{name}.*", r".*/(?:{name}|zz).*", r"(?i).*/{name}\.7\.png"):
        want = sorted((k, u) for k in keys for u in uris if folder(k) == folder(u) and re.search((re.match(r"\(\?i\)", pattern) or [""])[0] + "^(?:" + pattern.removeprefix("(?i)").replace("{name}", re.escape(k.rsplit("/", 1)[1])) + ")$", u, re.A))
        assert sorted(tuple(r) for r in L.thumbnails_by_pattern(assets, listing, pattern).collect()) == want, pattern
    many = spark.range(30_000).select(F.concat(F.lit("s3://b/d/n"), F.col("id").cast("string")).alias("base_key"))
    thumbs = many.select(F.concat(F.lit("s3://b/d/.thumbs/"), F.substring_index("base_key", "/", -1), F.lit(".7.png")).alias("uri"))
    assert L.thumbnails_by_pattern(many, thumbs, r".*/\.thumbs/{name}\.\d\.png").count() == 30_000  # 900 million pairs in the folder
