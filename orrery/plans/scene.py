"""Queries of prims and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.operators import graph as G
from orrery.operators import prims as Q
from orrery.operators.spatial import write_layout
from orrery.sources import fixtures as X
from orrery.sources.tables import shared_dir

from .base import query

PS, ED, CY = X.PRIMS, X.EDGES, X.CYCLIC


@query(f"WITH {PS} SELECT scene_url, usd_path FROM prims WHERE prim_type IN ('Mesh', 'Xform') AND (root_prim OR default_prim) AND starts_with(usd_path, '/Root/L')")
def x01_filter_prims(spark, d):
    return Q.filter_prims(X.prims(spark, d), types=["Mesh", "Xform"], prefix="/Root/L", root=True, default=True).select("scene_url", "usd_path")


@query(f"WITH {PS} SELECT scene_url, usd_path FROM prims WHERE status = 'F' AND line >= 2 AND price < 50000.5 AND visible")
def x02_property_filter(spark, d):
    return X.prims(spark, d).filter(Q.property_filter("status=~[FG],line>=2,price<50000.5,visible=True")).select("scene_url", "usd_path")


@query(f"WITH {PS} SELECT scene_url, usd_path, abs(max_y - min_y) AS dim_y, abs(max_z - min_z) * scene_mpu AS scaled_z FROM prims WHERE abs(max_x - min_x) * scene_mpu > 0.005 AND abs(max_z - min_z) < 4e38")
def x03_dimensions(spark, d):
    """X3 and X8."""
    p = Q.with_dimensions(X.prims(spark, d))
    return p.filter(Q.dimension_filter({"x": 0.005}) & Q.dimension_filter(most={"z": Q.MOST_DIMENSION}, scaled=False)).select("scene_url", "usd_path", "dim_y", "scaled_z")


@query(f"WITH {PS} SELECT scene_url, usd_path FROM prims WHERE mid_x BETWEEN 10 AND 20.5 AND mid_y BETWEEN 2 AND 6 AND mid_z BETWEEN 1.5 AND 4")
def x04_in_box(spark, d):
    return Q.in_box(X.prims(spark, d), (10, 2, 1.5), (20.5, 6, 4)).select("scene_url", "usd_path")


@query(f"WITH {PS} SELECT scene_url, usd_path, round(sqrt((mid_x - 25) * (mid_x - 25) + (mid_y - 5) * (mid_y - 5) + (mid_z - 4) * (mid_z - 4)), 9) AS distance FROM prims WHERE sqrt((mid_x - 25) * (mid_x - 25) + (mid_y - 5) * (mid_y - 5) + (mid_z - 4) * (mid_z - 4)) < 5 ORDER BY sqrt((mid_x - 25) * (mid_x - 25) + (mid_y - 5) * (mid_y - 5) + (mid_z - 4) * (mid_z - 4)), scene_url, usd_path LIMIT 100")
def x05_near_point(spark, d):
    """The nearest hundred."""
    return Q.near_point(X.prims(spark, d), (25.0, 5.0, 4.0), 5.0, 100).select("scene_url", "usd_path", F.round("distance", 9).alias("distance"))


@query(f"""WITH {PS}, c AS (SELECT scene_url, usd_path AS centre_path, mid_x AS cx, mid_y AS cy, mid_z AS cz FROM prims WHERE default_prim)
SELECT scene_url, centre_path, usd_path, round(mid_y - cy, 9) + 0.0 AS moved_x, round(2 * (mid_x - cx), 9) + 0.0 AS moved_y, round(mid_z - cz, 9) + 0.0 AS moved_z FROM prims JOIN c USING (scene_url) WHERE sqrt((mid_x - cx) * (mid_x - cx) + (mid_y - cy) * (mid_y - cy) + (mid_z - cz) * (mid_z - cz)) < 7.3""")
def x06_near_prims(spark, d):
    """X6 and X7 around every scene's default prim."""
    p = X.prims(spark, d)
    near = Q.near_prims(p, p.filter("default_prim").select("scene_url", F.col("usd_path").alias("centre_path")), 7.3)
    moved = Q.transform_offset(near, [[0, 2, 0], [1, 0, 0], [0, 0, 1]])
    return moved.select("scene_url", "centre_path", "usd_path", *((F.round(f"moved_{a}", 9) + 0.0).alias(f"moved_{a}") for a in Q.AXES))


FLOORS = f"{PS}, floors AS (SELECT 'floor_' || line AS scene_url, scene_url || usd_path AS usd_path, mid_x, mid_y, mid_z FROM prims)"
SPOTS = "spots AS (SELECT s_suppkey AS spot, 'floor_' || (1 + s_nationkey % 7) AS scene_url, 25 + s_acctbal::DOUBLE / 500 AS x, s_nationkey / 2.5::DOUBLE AS y, (s_suppkey % 9)::DOUBLE AS z FROM supplier)"
APART = "sqrt((mid_x - x) * (mid_x - x) + (mid_y - y) * (mid_y - y) + (mid_z - z) * (mid_z - z))"


def _floors(spark, d):
    """All prims on seven dense floors, one for each line number, stored along the curve."""
    p = X.prims(spark, d).withColumn("usd_path", F.concat("scene_url", "usd_path")).withColumn("scene_url", F.concat(F.lit("floor_"), F.col("curve_segment_count").cast("string")))
    return write_layout(p.select("scene_url", "usd_path", "mid_x", "mid_y", "mid_z"), f"{shared_dir(spark)}/floors-{uuid.uuid4().hex}")


def _spots(spark, d):
    s = X.table(spark, d, "supplier")
    floor = F.concat(F.lit("floor_"), (F.col("s_nationkey") % 7 + 1).cast("string"))
    return s.select(F.col("s_suppkey").alias("spot"), floor.alias("scene_url"), (F.col("s_acctbal").cast("double") / 500 + 25).alias("x"), (F.col("s_nationkey") / F.lit(2.5).cast("double")).alias("y"), (F.col("s_suppkey") % 9).cast("double").alias("z"))


@query(f"WITH {FLOORS}, {SPOTS} SELECT spot, scene_url, usd_path FROM floors JOIN spots USING (scene_url) WHERE mid_x BETWEEN x - 2 AND x + 2 AND mid_y BETWEEN y - 1 AND y + 1 AND mid_z BETWEEN z - 1 AND z + 1")
def x04_boxes(spark, d):
    """X4 for a table of boxes, over the stored layout."""
    ends = (f for a, r in (("x", 2), ("y", 1), ("z", 1)) for f in ((F.col(a) - r).alias(f"least_{a}"), (F.col(a) + r).alias(f"most_{a}")))
    return _floors(spark, d).in_boxes(_spots(spark, d).select("spot", "scene_url", *ends)).select("spot", "scene_url", "usd_path")


@query(f"WITH {FLOORS}, {SPOTS} SELECT spot, usd_path, round({APART}, 9) AS distance FROM floors JOIN spots USING (scene_url) QUALIFY row_number() OVER (PARTITION BY spot ORDER BY {APART}, usd_path) <= 12")
def x05_nearest(spark, d):
    """X5 for a table of points: the twelve nearest of each, however far."""
    return _floors(spark, d).near(_spots(spark, d), limit=12).select("spot", "usd_path", F.round("distance", 9).alias("distance"))


@query(f"WITH {FLOORS}, {SPOTS} SELECT spot, usd_path, round({APART}, 9) AS distance FROM floors JOIN spots USING (scene_url) WHERE {APART} < 1.5")
def x05_within(spark, d):
    """X5 for a table of points without a limit."""
    return _floors(spark, d).near(_spots(spark, d), 1.5).select("spot", "usd_path", F.round("distance", 9).alias("distance"))


@query(f"""WITH {PS}, c AS (SELECT scene_url, usd_path AS centre_path, mid_x AS x, mid_y AS y, mid_z AS z FROM prims WHERE default_prim)
SELECT scene_url, centre_path, usd_path, round({APART}, 9) AS distance FROM prims JOIN c USING (scene_url) WHERE {APART} < 30 QUALIFY row_number() OVER (PARTITION BY scene_url ORDER BY {APART}, usd_path) <= 3""")
def x06_nearest_prims(spark, d):
    """X6 with a limit around every scene's default prim. Only the columns asked for are stored in the layout."""
    p = X.prims(spark, d).select("scene_url", "usd_path", "default_prim", *(f"mid_{a}" for a in Q.AXES))
    near = Q.near_prims(p, p.filter("default_prim").select("scene_url", F.col("usd_path").alias("centre_path")), 30.0, 3)
    return near.select("scene_url", "centre_path", "usd_path", F.round("distance", 9).alias("distance"))


@query(f"""WITH {PS}, t AS (SELECT scene_url, string_agg(prim_type || '=' || n, ',' ORDER BY prim_type) AS types FROM (SELECT scene_url, prim_type, count(*) AS n FROM prims GROUP BY 1, 2) GROUP BY 1)
SELECT scene_url, count(*) AS prims, sum(polygon_count)::BIGINT AS polygons, sum(point_count)::BIGINT AS points, sum(curve_segment_count)::BIGINT AS curve_segments, min(usd_path) AS default_prim, any_value(types) AS types, count(*) AS n_line, count(DISTINCT source_asset_url)::INT AS n_assets, count(DISTINCT status)::INT + count(DISTINCT line)::INT + count(DISTINCT visible)::INT AS n_values, CASE WHEN split_part(scene_url, '_', 2)::BIGINT % 2 = 0 THEN 'Y' ELSE 'Z' END AS up_axis FROM prims JOIN t USING (scene_url) GROUP BY 1""")
def a07_scene_summary(spark, d):
    axis = F.when(F.split_part("scene_url", F.lit("_"), F.lit(2)).cast("long") % 2 == 0, "Y").otherwise("Z")
    s = Q.scene_summary(X.prims(spark, d).withColumn("scene_up_axis", axis))
    types = F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("scene_url", "prims", "polygons", "points", "curve_segments", "default_prim", types.alias("types"), F.col("by_key")["line"].alias("n_line"), F.size("by_asset").alias("n_assets"), F.size("by_value").alias("n_values"), "up_axis")


@query(f"WITH {PS} SELECT scene_url, usd_path, CASE WHEN default_prim THEN (sum(polygon_count) OVER (PARTITION BY scene_url))::BIGINT::VARCHAR END AS total FROM prims")
def a08_geometry_totals(spark, d):
    return Q.geometry_totals(X.prims(spark, d)).select("scene_url", "usd_path", F.col("properties")["scene_polygons"].alias("total"))


@query(f"WITH {PS} SELECT scene_url, usd_path, abs(max_x - min_x) AS dim_x, abs(max_y - min_y) * scene_mpu AS scaled_y FROM prims WHERE default_prim")
def f17_default_prim(spark, d):
    return Q.default_prim_dimensions(X.prims(spark, d)).select("scene_url", "usd_path", "dim_x", "scaled_y")


@query(f"WITH {PS} SELECT scene_url AS src, scene_url || ':' || usd_path AS dst, 'ROOT_PRIM' AS type FROM prims WHERE root_prim UNION ALL SELECT scene_url || ':' || usd_path, source_asset_url, 'SOURCE_ASSET' FROM prims UNION ALL SELECT scene_url || ':' || usd_path || '/geo', scene_url || ':' || usd_path, 'PARENT' FROM prims UNION ALL SELECT scene_url || ':' || usd_path || '/geo', source_asset_url, 'SOURCE_ASSET' FROM prims")
def j08_prim_links(spark, d):
    p = X.prims(spark, d).select("scene_url", "usd_path", "root_prim", "source_asset_url")
    geo = F.struct(F.concat("usd_path", F.lit("/geo")).alias("usd_path"), F.lit(False).alias("root_prim"))
    both = p.withColumn("_e", F.explode(F.array(F.struct("usd_path", "root_prim"), geo)))
    return Q.prim_links(both.select("scene_url", "_e.usd_path", "_e.root_prim", "source_asset_url"))


def _roots(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "root string")


def _reach(edges: str, roots: str, most: int = 99) -> str:
    return f"WITH RECURSIVE {edges}, de AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT root, root AS node, 0 AS level FROM (VALUES {roots}) v(root) UNION SELECT r.root, de.dst, r.level + 1 FROM r JOIN de ON de.src = r.node WHERE r.level < {most}), l AS (SELECT root, node, min(level) AS level FROM r GROUP BY 1, 2)"


@query(_reach(ED, "('region_1'), ('customer_7')") + " SELECT root, node, level FROM l WHERE level > 0")
def g01_dependencies(spark, d):
    return G.dependencies_flat(X.edges(spark, d), _roots(spark, "region_1", "customer_7"))


@query(_reach(f"{ED.replace('edges AS', 'fwd AS')}, edges AS (SELECT dst AS src, src AS dst FROM fwd)", "('part_3'), ('order_5')") + " SELECT root, node, level FROM l WHERE level > 0")
def g02_inverse(spark, d):
    return G.dependencies_inverse(X.edges(spark, d), _roots(spark, "part_3", "order_5"))


@query(_reach(CY, "('v_5'), ('v_17')", 4) + " SELECT DISTINCT a.root, de.src, de.dst FROM de JOIN l a ON a.node = de.src JOIN l b ON b.node = de.dst AND a.root = b.root")
def g03_graph_edges(spark, d):
    """G3 and U3 over a cyclic graph, four levels deep."""
    return G.dependency_graph(X.cyclic_edges(spark, d), _roots(spark, "v_5", "v_17"), 4)[1]


@query(_reach(f"{CY.replace('edges AS', 'fwd AS')}, edges AS (SELECT dst AS src, src AS dst FROM fwd)", "('v_5')", 3) + " SELECT root, node, level FROM l")
def g04_inverse_graph(spark, d):
    return G.inverse_dependency_graph(X.cyclic_edges(spark, d), _roots(spark, "v_5"), 3)[0]


@query(f"WITH {ED}, u AS (SELECT 'part_1' AS url UNION ALL SELECT 'region_0'), a AS (SELECT DISTINCT src AS url FROM edges UNION SELECT dst FROM edges) SELECT a.url, a.url IN (SELECT url FROM u) AS deleted FROM a WHERE a.url NOT IN (SELECT url FROM u WHERE url NOT IN (SELECT dst FROM edges))")
def g05_delete_asset(spark, d):
    e = X.edges(spark, d)
    assets = G.all_nodes(e.select(F.col("src").alias("node")), e).select(F.col("node").alias("url"), F.lit(False).alias("deleted"))
    return G.delete_assets(assets, e, spark.createDataFrame([("part_1",), ("region_0",)], "url string"))[0]


@query(_reach(ED, "('nation_3')") + ", a AS (SELECT src AS url FROM edges UNION SELECT dst FROM edges) SELECT url FROM a WHERE url NOT IN (SELECT node FROM l WHERE level > 0)")
def g06_delete_subgraph(spark, d):
    """G6 and U4."""
    e = X.edges(spark, d)
    return G.delete_subgraph(G.all_nodes(e.select(F.col("src").alias("node")), e).withColumnRenamed("node", "url"), e, _roots(spark, "nation_3"))


@query(f"WITH {PS} SELECT scene_url, usd_path FROM prims WHERE starts_with(usd_path, '/Root/L1_1')")
def g07_subtree(spark, d):
    return G.prim_subtree(X.prims(spark, d), "/Root/L1_1").select("scene_url", "usd_path")


@query(_reach(CY, "('v_0'), ('v_1'), ('v_2')") .replace("UNION SELECT r.root, de.dst, r.level + 1 FROM r JOIN de ON de.src = r.node WHERE r.level < 99", "UNION SELECT r.root, de.dst, r.level + 1 FROM r JOIN de ON de.src = r.node WHERE r.level < 12") + " SELECT root, node, level FROM l")
def g08_levels(spark, d):
    return G.dependency_levels(X.cyclic_edges(spark, d), _roots(spark, "v_0", "v_1", "v_2"), 12)


@query(f"WITH {ED} SELECT DISTINCT dst AS ref FROM edges")
def g09_unique_refs(spark, d):
    return G.unique_refs(X.edges(spark, d))


@query("SELECT DISTINCT 's3://b/' || source || '/m/' || doc_id || '.usd' AS src, unnest(['s3://b/' || source || '/tex/' || lang || '.png', 's3://b/' || source || '/m/' || (doc_id + 1) || '.usd']) AS dst, 'depends_on' AS type FROM documents")
def g10_dependency_edges(spark, d):
    url = F.concat(F.lit("s3://b/"), "source", F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".usd"))
    refs = F.array(F.concat(F.lit("../tex/./"), "lang", F.lit(".png")), F.concat(F.lit("./"), (F.col("doc_id") + 1).cast("string"), F.lit(".usd")), url)
    return G.dependency_edges(X.table(spark, d, "documents").select(url.alias("url"), refs.alias("refs")))


@query(_reach(ED, "('customer_7'), ('customer_8')") + """, m AS (SELECT root, node AS url, CASE WHEN node LIKE 'part%' THEN right(node, 2)::INT * 10 ELSE 7 END AS size, CASE WHEN node LIKE '%3' THEN 'deleted' WHEN node LIKE '%4' THEN 'no access' END AS reason FROM (SELECT root, node FROM l) q)
SELECT root, url, reason, CASE WHEN reason IS NULL THEN 'd/' || url || '.usd' END AS archive_path, sum(size) FILTER (reason IS NULL) OVER (PARTITION BY root)::BIGINT AS total_size, sum(size) FILTER (reason IS NULL) OVER (PARTITION BY root) > 1000 AS too_large FROM m""".replace("right(node, 2)::INT * 10", "10"))
def s16_bundle_manifest(spark, d):
    e = X.edges(spark, d)
    name = lambda c: F.concat(F.lit("s3://b/d/"), c, F.lit(".usd"))
    nodes = G.all_nodes(e.select(F.col("src").alias("node")), e)
    assets = nodes.select(name(F.col("node")).alias("url"), F.when(F.col("node").startswith("part"), 10).otherwise(7).alias("size"), F.col("node").endswith("3").alias("deleted"))
    access = nodes.filter(~F.col("node").endswith("4")).select(name(F.col("node")).alias("url"))
    moved = e.select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))
    m = G.bundle_manifest(moved, assets, _roots(spark, "s3://b/d/customer_7.usd", "s3://b/d/customer_8.usd"), access, 1000)
    bare = lambda c: F.regexp_extract(c, r"/d/(.*)\.usd$", 1)
    return m.select(bare(F.col("root")).alias("root"), bare(F.col("url")).alias("url"), "reason", F.when(F.col("archive_path").isNotNull(), F.concat(F.lit("d/"), "archive_path")).alias("archive_path"), "total_size", "too_large")
