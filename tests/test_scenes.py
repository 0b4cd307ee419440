"""Prims of scenes: what is read, dealt and stored, and neighbours at the borders of cells."""

import math
import random

from pyspark.sql import functions as F

from orrery.operators import prims as Q
from orrery.operators import spatial
from orrery.plans import catalog
from orrery.sources import fixtures as X
from orrery.sources import ingest as I

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prims_are_dealt_by_scene_once(spark):
    """Grouping, the least path and totals by scene need one shuffle; a summary has one for each of its two aggregates."""
    assert plan(X.prims(spark, SF)).count("Exchange hashpartitioning") == 1
    assert plan(X.prims(spark, SF).groupBy("scene_url").agg(F.count("*"), F.min("mid_x"))).count("Exchange hashpartitioning") == 1
    assert plan(catalog.queries()["a07_scene_summary"](spark, SF)).count("Exchange hashpartitioning") == 2
    assert plan(catalog.queries()["s08_ingest_assets"](spark, SF)).count("Exchange hashpartitioning") == 2


def test_scene_documents_are_read_once_for_assets(spark, tmp_path):
    doc = '{"scene_url": "%s", "assets": %s, "prims": {}}'
    (tmp_path / "s.json").write_text("\n".join([doc % ("a", '[{"url": "x", "size": 3}, {"url": "b", "size": 9}]'), doc % ("b", "null"), doc % ("c", "[]"), doc % ("d", '[{"url": "x"}]')]))
    assets = I.ingest_scenes(I.read_scenes(spark, f"file://{tmp_path}/s.json"))[0]
    assert plan(assets).count("FileScan") == 1
    assert {(r.url, r["size"]) for r in assets.collect()} == {("a", None), ("b", 9), ("c", None), ("d", None), ("x", 3)}


def test_neighbours_at_the_borders_of_cells(spark):
    """A centre goes to eight cells or so, and finds what brute force finds, also on borders, below zero and far out."""
    r, radius = random.Random(3), 0.7
    grid = [i * radius / 2 for i in range(-5, 6)]
    spots = [(r.choice(grid), r.choice(grid), r.choice(grid)) for _ in range(150)] + [tuple(r.uniform(-2, 2) for _ in range(3)) for _ in range(150)] + [(1e12 + i * 0.35, 0.0, 0.0) for i in range(6)]
    rows = [("s", f"/p{i}", *map(float, x)) for i, x in enumerate(spots)]
    prims = spark.createDataFrame(rows, "scene_url string, usd_path string, mid_x double, mid_y double, mid_z double")
    got = {(x.centre_path, x.usd_path) for x in Q.near_prims(prims, prims.select("scene_url", F.col("usd_path").alias("centre_path")), radius).collect()}
    length = lambda p, q: math.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q)), 0.0))
    assert got == {(a[1], b[1]) for a in rows for b in rows if length(b[2:], a[2:]) < radius}
    sizes = prims.select(F.size(Q.met_cells(F.col("mid_x") / (2 * radius))).alias("n"), (F.abs(F.col("mid_x") / (2 * radius) % 1) == 0.5).alias("middle")).filter("not middle and mid_x < 1e6").agg(F.avg("n")).first()[0]
    assert 1.9 < sizes < 2.3


def test_a_query_stores_only_its_columns(spark, monkeypatch):
    stored, write = [], spatial.write_layout
    monkeypatch.setattr(spatial, "write_layout", lambda prims, *a: (stored.append(prims.columns), write(prims, *a))[1])
    assert catalog.queries()["x06_nearest_prims"](spark, SF).count()
    assert stored == [["scene_url", "usd_path", "default_prim", "mid_x", "mid_y", "mid_z"]]


def test_prims_without_a_path_are_neighbours_but_no_centres(spark):
    prims = spark.createDataFrame([("s", "/a", 0.0, 0.0, 0.0), ("s", None, 0.1, 0.0, 0.0), (None, "/a", 0.0, 0.0, 0.0)], "scene_url string, usd_path string, mid_x double, mid_y double, mid_z double")
    centres = spark.createDataFrame([("s", "/a"), ("s", None), (None, "/a")], "scene_url string, centre_path string")
    assert {(r.centre_path, r.usd_path) for r in Q.near_prims(prims, centres, 1.0).collect()} == {("/a", "/a"), ("/a", None)}


def test_a_layout_computes_its_prims_once(spark, tmp_path):
    """Bounds, ranges and the layout read rows that are written once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    prims = spark.createDataFrame([("s", f"/p{i}", float(i), 0.0, 0.0) for i in range(50)], "scene_url string, usd_path string, x double, mid_y double, mid_z double")
    prims = prims.withColumn("mid_x", counted.asNondeterministic()("x")).drop("x")
    assert spatial.write_layout(prims, f"file://{tmp_path}/l").prims.count() == 50
    assert seen.value == 50
