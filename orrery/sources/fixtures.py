"""The engine's tables derived from the driver's tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, d: str) -> DataFrame:
    """One row per storage URI."""
    doc = table(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, ("usd", "usda", "png", "jpg", "mdl"))), (F.col("doc_id") % 5 + 1).cast("int"))
    out = doc.select(
        F.col("doc_id").alias("asset_id"),
        ext.alias("ext"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"),
        (F.col("n_chars") * 1024).alias("size"),
        F.col("source").alias("created_by"),
        F.col("lang").alias("modified_by"),
        F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("created_timestamp"),
        F.timestamp_add("HOUR", (F.col("doc_id") + F.col("doc_id") % 48).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("modified_timestamp"),
        F.md5("text").alias("hash_value"),
        (F.col("doc_id") % 97 == 0).alias("is_deleted"),
        "text",
        "source",
        "lang",
    )
    return out.withColumn("base_key", F.concat(F.lit("s3://bucket/"), "source", F.lit("/"), "lang", F.lit("/"), "name")).withColumn("path", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), "name"))


def asset_views(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("long").alias("asset_id"), (F.col("vec_id") % 2).cast("int").alias("view_offset"), "embedding", F.concat(F.lit("img_"), F.col("vec_id").cast("string")).alias("image"), F.col("label").cast("string").alias("label"), F.array(F.col("label").cast("string")).alias("keyword"))


def _prop(name: str, value, kind: str, numeric=None):
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(kind).alias("value_type"), (F.lit(None) if numeric is None else numeric).cast("double").alias("value_numeric"))


def prop_assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets with their nested properties."""
    p = table(spark, d, "part")
    props = F.array(_prop("brand", F.col("p_brand"), "str"), _prop("type", F.col("p_type"), "str"), _prop("size", F.col("p_size"), "int", F.col("p_size")), _prop("retail", F.col("p_retailprice"), "float", F.col("p_retailprice")))
    return p.select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), props.alias("props"))


def tag_assets(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda n: F.struct(F.lit(n).alias("tag"), F.lit("appearance").alias("namespace"), F.col(n).cast("string").alias("value"))
    return table(spark, d, "labels").select(F.col("doc_id").alias("asset_id"), F.array(tag("quality"), tag("toxic")).alias("tags"))


def vlm_assets(spark: SparkSession, d: str) -> DataFrame:
    """Generated metadata: a map from plugin to entries."""
    entry = "struct<name:string,value_text:array<string>,value_bool:boolean>"
    one = F.struct(F.lit("language").alias("name"), F.array("lang").alias("value_text"), F.lit(None).cast("boolean").alias("value_bool")).cast(entry)
    two = F.struct(F.lit("origin").alias("name"), F.array(F.concat("source", F.lit(" crawl"))).alias("value_text"), (F.col("n_chars") > 1000).alias("value_bool")).cast(entry)
    return table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.create_map(F.lit("caption"), F.array(one), F.lit("provenance"), F.array(two)).alias("vlm"))


def prims(spark: SparkSession, d: str) -> DataFrame:
    """Scene-graph nodes; boxes from line items, one scene per order. Line items are dealt by scene once, which is all that their grouping, the least path and what groups by scene later need."""
    li = table(spark, d, "lineitem")
    keys, values = ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"]
    dealt = li.select(F.concat(F.lit("scene_"), F.col("l_orderkey").cast("string")).alias("scene_url"), *keys, *values).repartition("scene_url")
    g = dealt.groupBy("scene_url", *keys).agg(*(F.min(c).alias(c) for c in values))
    x, y, z = F.col("l_quantity"), F.col("l_discount") * 100 + 0.0, F.col("l_tax") * 100 + 0.0
    path = F.concat(F.lit("/Root/L"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"))
    out = g.select(
        "scene_url", path.alias("usd_path"), F.element_at(F.create_map(F.lit("A"), F.lit("Mesh"), F.lit("N"), F.lit("Xform"), F.lit("R"), F.lit("Material")), F.col("l_returnflag")).alias("prim_type"),
        F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("source_asset_url"),
        x.alias("min_x"), y.alias("min_y"), z.alias("min_z"), (x + 1).alias("max_x"), (y + 2).alias("max_y"), (z + 3).alias("max_z"),
        (x + 0.5).alias("mid_x"), (y + 1.0).alias("mid_y"), (z + 1.5).alias("mid_z"), F.lit(0.01).alias("scene_mpu"),
        F.col("l_quantity").cast("int").alias("polygon_count"), (F.col("l_quantity") * 3).cast("int").alias("point_count"), F.col("l_linenumber").alias("curve_segment_count"),
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("line"), F.col("l_linenumber").cast("string"), F.lit("visible"), (F.col("l_linenumber") % 2 == 0).cast("string")).alias("properties"),
        F.create_map(F.lit("line"), F.col("l_linenumber").cast("double"), F.lit("price"), F.col("l_extendedprice")).alias("numbers"),
    )
    first = F.min("usd_path").over(Window.partitionBy("scene_url"))
    return out.filter("scene_url is not null").withColumn("default_prim", F.col("usd_path") == first).withColumn("root_prim", F.col("usd_path").startswith("/Root/L1_"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """depends_on edges: region, nation, customer, order, part."""
    name = lambda kind, c: F.concat(F.lit(kind + "_"), F.col(c).cast("string"))
    parts = [
        table(spark, d, "nation").select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst")),
        table(spark, d, "customer").select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst")),
        table(spark, d, "orders").select(name("customer", "o_custkey").alias("src"), name("order", "o_orderkey").alias("dst")),
        table(spark, d, "lineitem").select(name("order", "l_orderkey").alias("src"), name("part", "l_partkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("type", F.lit("depends_on"))


def cyclic_edges(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"))
    n = v.agg(F.count("*").alias("n"))
    v = v.join(F.broadcast(n))
    node = lambda c: F.concat(F.lit("v_"), c.cast("string"))
    return v.select(node(F.col("i")).alias("src"), node((7 * F.col("i") + 1) % F.col("n")).alias("dst")).unionByName(v.select(node(F.col("i")).alias("src"), node((3 * F.col("i") + 2) % F.col("n")).alias("dst"))).withColumn("type", F.lit("depends_on"))


def _change(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("uri"), F.when(F.col("event_type") == "error", "delete").otherwise("create").alias("event"),
        F.col("props").alias("hash_value"), (F.col("value") * 100).cast("long").alias("size"), F.when(F.col("event_type") == "click", "subscription").otherwise("recursive_list").alias("source"), "event_type",
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    return _change(table(spark, d, "events"))


def change_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same records as a file stream."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return _change(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))


ASSETS = """assets AS (
  SELECT *, 's3://bucket/' || source || '/' || lang || '/' || name AS base_key, '/' || source || '/' || lang || '/' || name AS path FROM (
    SELECT doc_id AS asset_id, ['usd', 'usda', 'png', 'jpg', 'mdl'][(doc_id % 5 + 1)::INT] AS ext, 'doc_' || doc_id || '.' || ['usd', 'usda', 'png', 'jpg', 'mdl'][(doc_id % 5 + 1)::INT] AS name, n_chars * 1024 AS size,
      source AS created_by, lang AS modified_by, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_timestamp, TIMESTAMP '2024-01-01' + to_hours(doc_id + doc_id % 48) AS modified_timestamp,
      md5(text) AS hash_value, doc_id % 97 = 0 AS is_deleted, text, source, lang FROM documents))"""
VIEWS = "asset_views AS (SELECT vec_id // 2 AS asset_id, (vec_id % 2)::INT AS view_offset, embedding, 'img_' || vec_id AS image, label::VARCHAR AS label, [label::VARCHAR] AS keyword FROM embeddings)"
PROPS = """props AS (
  SELECT asset_id, name, unnest([{'k': 'brand', 'v': p_brand, 't': 'str', 'n': NULL::DOUBLE}, {'k': 'type', 'v': p_type, 't': 'str', 'n': NULL}, {'k': 'size', 'v': p_size::VARCHAR, 't': 'int', 'n': p_size}, {'k': 'retail', 'v': p_retailprice::VARCHAR, 't': 'float', 'n': p_retailprice}], recursive := true)
  FROM (SELECT p_partkey AS asset_id, p_name AS name, * FROM part))"""
PRIMS = """prims AS (
  SELECT *, usd_path = min(usd_path) OVER (PARTITION BY scene_url) AS default_prim, starts_with(usd_path, '/Root/L1_') AS root_prim FROM (
    SELECT 'scene_' || l_orderkey AS scene_url, '/Root/L' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS usd_path, CASE l_returnflag WHEN 'A' THEN 'Mesh' WHEN 'N' THEN 'Xform' WHEN 'R' THEN 'Material' END AS prim_type, 'part_' || l_partkey AS source_asset_url,
      q AS min_x, di * 100 + 0.0 AS min_y, t * 100 + 0.0 AS min_z, q + 1 AS max_x, di * 100 + 0.0 + 2 AS max_y, t * 100 + 0.0 + 3 AS max_z, q + 0.5 AS mid_x, di * 100 + 0.0 + 1.0 AS mid_y, t * 100 + 0.0 + 1.5 AS mid_z, 0.01::DOUBLE AS scene_mpu,
      q::INT AS polygon_count, (q * 3)::INT AS point_count, l_linenumber AS curve_segment_count, l_linestatus AS status, l_linenumber AS line, l_linenumber % 2 = 0 AS visible, price
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS q, min(l_discount) AS di, min(l_tax) AS t, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL)))"""
EDGES = """edges AS (
  SELECT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey FROM customer
  UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey FROM orders UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey FROM lineitem)"""
CYCLIC = "edges AS (SELECT 'v_' || vec_id AS src, 'v_' || ((7 * vec_id + 1) % n) AS dst FROM embeddings, (SELECT count(*) AS n FROM embeddings) UNION ALL SELECT 'v_' || vec_id, 'v_' || ((3 * vec_id + 2) % n) FROM embeddings, (SELECT count(*) AS n FROM embeddings))"
CHANGES = "changes AS (SELECT event_id AS seq, ts, 'u_' || user_id AS uri, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'create' END AS event, props AS hash_value, trunc(value * 100)::BIGINT AS size, CASE WHEN event_type = 'click' THEN 'subscription' ELSE 'recursive_list' END AS source, event_type FROM events)"
TAGS = "tags AS (SELECT doc_id AS asset_id, 'quality' AS tag, 'appearance' AS namespace, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, 'toxic', 'appearance', toxic::VARCHAR FROM labels)"
