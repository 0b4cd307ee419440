"""Queries of statistics, lookups, windows and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import evaluation as V
from orrery.operators import graph as G
from orrery.operators import lookups as L
from orrery.operators import retrieval as R
from orrery.operators import stats as S
from orrery.sources import fixtures as X
from orrery.sources.tables import written

from .base import query

A, VW, PR, PS, ED = X.ASSETS, X.VIEWS, X.PROPS, X.PRIMS, X.EDGES


def _stats(level):
    def run(spark, d):
        return S.property_stats(X.prop_assets(spark, d)).filter(F.col("level") == level).select(*{"keys": ["key"], "values": ["value"], "pairs": ["key", "value"]}[level], "n", "n_assets")

    return run


for _n, _level, _cols in (("a01_key_stats", "keys", "k AS key"), ("a02_value_stats", "values", "v AS value"), ("a03_pair_stats", "pairs", "k AS key, v AS value")):
    _fn = _stats(_level)
    _fn.__name__ = _n
    query(f"WITH {PR} SELECT {_cols}, count(*) AS n, count(DISTINCT asset_id) AS n_assets FROM props GROUP BY ALL")(_fn)


@query(f"WITH {PR} SELECT k || '=' || v AS key, count(*) AS n FROM props GROUP BY 1 HAVING k || '=' || v > 'brand=Brand#17' ORDER BY key LIMIT 25".replace("GROUP BY 1 HAVING k || '=' || v", "GROUP BY 1 HAVING key"))
def a04_paged(spark, d):
    s = S.property_stats(X.prop_assets(spark, d)).filter("level = 'pairs'").select(F.concat("key", F.lit("="), "value").alias("key"), "n")
    return S.page_after(s, 25, "brand=Brand#17")


@query(f"WITH {VW} SELECT label AS keyword, count(DISTINCT asset_id) AS documents, count(*) AS n FROM asset_views WHERE view_offset = 0 AND asset_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY 1")
def a05_keyword_histogram(spark, d):
    return S.keyword_histogram(X.asset_views(spark, d), F.col("view_offset") == 0, X.assets(spark, d).filter("lang = 'en'"))


@query("SELECT DISTINCT label::VARCHAR AS keyword FROM embeddings")
def a06_distinct_keywords(spark, d):
    return S.distinct_keywords(X.asset_views(spark, d))


_CATALOG = f"""WITH {PR}, pv AS (SELECT k, v, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, v) AS r FROM props GROUP BY 1, 2), c AS (
  SELECT k AS key, count(*) AS cardinality, CASE WHEN k IN ('size', 'retail') THEN 'number' ELSE 'string' END AS kind, list(v ORDER BY r) FILTER (r <= 5) AS top_values FROM pv GROUP BY 1), cat AS (SELECT *, (SELECT count(DISTINCT asset_id) FROM props) AS n_assets, row_number() OVER (ORDER BY key) AS place FROM c)"""


@query(_CATALOG + " SELECT key, cardinality, kind, top_values, n_assets, place FROM cat")
def a09_property_catalog(spark, d):
    c = S.property_catalog(X.prop_assets(spark, d))
    return c.select("key", "cardinality", "kind", "top_values", "n_assets", F.col("place").cast("long").alias("place"))


@query(_CATALOG + " SELECT key, CASE key WHEN 'size' THEN 'size_' || 'f7c0246a' ELSE key END AS field, CASE kind WHEN 'number' THEN 'numeric' ELSE 'property' END AS kind, CASE kind WHEN 'number' THEN ['=', '>', '>=', '<', '<='] ELSE ['=', '~'] END AS operators FROM cat WHERE NOT (kind = 'string' AND cardinality > 10)")
def a10_filter_fields(spark, d):
    return S.derive_filter_fields(S.property_catalog(X.prop_assets(spark, d)), 10, 10, ["size"])


@query(_CATALOG + ", t(concept, pattern, recommended) AS (VALUES ('price', 'ret', 'retail'), ('maker', 'BRA|typ', 'none'), ('mass', 'weight', 'weight')), m AS (SELECT concept, arg_max(key, (key = recommended, n_assets, key)) AS best_key FROM t JOIN cat ON regexp_matches(key, '(?i)' || pattern) GROUP BY 1) SELECT concept, best_key IS NOT NULL AS present, best_key FROM t LEFT JOIN m USING (concept)")
def a11_target_audit(spark, d):
    t = spark.createDataFrame([("price", "ret", "retail"), ("maker", "BRA|typ", "none"), ("mass", "weight", "weight")], "concept string, pattern string, recommended string")
    return S.target_audit(S.property_catalog(X.prop_assets(spark, d)), t)


@query(_CATALOG + " SELECT place, key || ': ' || CASE WHEN kind = 'number' THEN 'number' WHEN cardinality <= 20 THEN array_to_string(top_values[1:8], ' | ') ELSE 'free text' END AS line FROM cat WHERE place <= 50")
def a12_grounding(spark, d):
    return S.property_grounding(S.property_catalog(X.prop_assets(spark, d))).withColumn("place", F.col("place").cast("long"))


def statuses(spark, d):
    """Plugin statuses from events: the type is the plugin, the value's parity the status."""
    e = X.table(spark, d, "events")
    return e.select(F.col("event_type").alias("plugin"), F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("uri"), F.when(F.floor("value") % 3 == 0, "failed").otherwise("processed").alias("status"), F.col("event_id").cast("double").alias("processing_timestamp"), F.col("props").alias("hash_value"))


def plugins(spark):
    return spark.createDataFrame([("click", ["usd"], True), ("view", ["usd", "usda"], True), ("purchase", ["png", "jpg"], True), ("thumb", ["png"], True)], "name string, data_types array<string>, active boolean")


_ST = "st AS (SELECT event_type AS plugin, 'u_' || user_id AS uri, CASE WHEN floor(value)::BIGINT % 3 = 0 THEN 'failed' ELSE 'processed' END AS status, event_id AS ts, props AS hash_value FROM events)"


@query(f"WITH {_ST}, l AS (SELECT plugin, uri, arg_max(status, ts) AS status FROM st GROUP BY 1, 2), p(plugin) AS (VALUES ('click'), ('view'), ('purchase'), ('thumb')), x AS (SELECT uri, plugin, coalesce(l.status, 'missing') AS status FROM (SELECT DISTINCT uri FROM st) CROSS JOIN p LEFT JOIN l USING (uri, plugin)) SELECT status, uri, list(plugin ORDER BY plugin) AS plugins FROM x WHERE status <> 'processed' GROUP BY 1, 2")
def a13_by_status(spark, d):
    st = statuses(spark, d)
    return S.assets_by_status(st, plugins(spark), st, exclude=["processed"])


@query("SELECT 'assets' AS store, count(*) AS n FROM documents UNION ALL SELECT 'views', count(*) FROM embeddings UNION ALL SELECT 'changes', count(*) FROM events")
def a14_index_size(spark, d):
    return S.index_size(assets=X.assets(spark, d), views=X.asset_views(spark, d), changes=X.changes(spark, d))


@query("SELECT event_type AS consumer, count(*) AS read, count(*) FILTER (value > 10) AS processed, (SELECT count(*) FROM events) - count(*) AS lag, round(100.0 * count(*) FILTER (value > 10) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1")
def a15_consumer_progress(spark, d):
    e = X.table(spark, d, "events")
    return S.consumer_progress(e, e.select(F.col("event_type").alias("consumer"), (F.col("value") > 10).alias("done"))).withColumn("percent", F.round("percent", 6))


# evaluation


def _qrels(spark, d):
    """Grade 1 where a document holds a benchmark text."""
    b = X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), "text")
    return V.holding(docs, b).withColumn("grade", F.lit(1))


def _class(c):
    return F.when(c % 2 == 0, "even").otherwise("odd")


def _legs(spark, d):
    from .retrieval import text_queries, vector_queries

    t = R.leg_window(R.text_leg(X.assets(spark, d), text_queries(spark, d), {"text": (F.col("text"), 1.0, 0.0)}), 0, 50)
    v = R.leg_window(R.vector_top(X.asset_views(spark, d), vector_queries(spark, d), R.window_size(0, 50)), 0, 50)
    one = lambda df, leg, n: df.select("query_id", _class(F.col("query_id")).alias("query_class"), "asset_id", F.lit(leg).alias("leg"), F.lit(n).alias("n"), "rank")
    return written(one(t, "text", 0).unionByName(one(v, "vector", 1)), "legs")


def _configs(spark):
    return spark.createDataFrame([("base", 60, 100, 1.0, 1.0), ("k10", 10, 100, 1.0, 1.0), ("text", 60, 100, 1.0, 0.0), ("narrow", 60, 5, 1.0, 1.0)], "config_id string, rank_constant int, window_size int, text_weight double, vector_weight double")


def _sweep_sql():
    from .retrieval import _VECTOR, _bm25, _rank

    return f"""WITH {_bm25()}, {_VECTOR}, {_rank('text_leg', 't', 100)}, {_rank('(SELECT query_id, asset_id, ip AS score FROM ip)', 'v', 100)}, legs AS (SELECT query_id, asset_id, 'text' AS leg, 0 AS n, rank FROM t UNION ALL SELECT query_id, asset_id, 'vector', 1, rank FROM v),
 cfg(config_id, k, w, tw, vw) AS (VALUES ('base', 60, 100, 1.0, 1.0), ('k10', 10, 100, 1.0, 1.0), ('text', 60, 100, 1.0, 0.0), ('narrow', 60, 5, 1.0, 1.0)),
 f AS (SELECT config_id, query_id, asset_id, sum(CASE leg WHEN 'text' THEN tw ELSE vw END::DOUBLE / (rank + k)) AS s, min((n, rank)) AS first FROM legs, cfg WHERE rank <= w GROUP BY 1, 2, 3),
 run AS (SELECT config_id, query_id, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS query_class, asset_id, row_number() OVER (PARTITION BY config_id, query_id ORDER BY round(s, 12) DESC, first, asset_id) AS rank FROM f),
 qrels AS (SELECT item_id AS query_id, doc_id AS asset_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS rel FROM qrels GROUP BY 1),
 e AS (SELECT query_id, config_id, query_class, any_value(rel) AS rel, count(q.asset_id) AS hits, min(rank) FILTER (q.asset_id IS NOT NULL) AS first, coalesce(sum(1.0 / log2(rank + 1)) FILTER (q.asset_id IS NOT NULL), 0) AS gain FROM run JOIN n USING (query_id) LEFT JOIN qrels q ON q.query_id = run.query_id AND q.asset_id = run.asset_id AND rank <= 10 GROUP BY 1, 2, 3),
 m AS (SELECT config_id, query_class, count(*) AS queries, avg(hits / 10.0) AS precision, avg(hits / rel) AS recall, avg(coalesce(1.0 / first, 0)) AS mrr, avg(gain / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(rel, 10)::BIGINT + 1) x(i))) AS ndcg FROM e GROUP BY 1, 2)"""


def _metrics(spark, d):
    return V.retrieval_metrics(V.config_sweep(_legs(spark, d), _configs(spark)), _qrels(spark, d))


@query(_sweep_sql() + " SELECT config_id, query_class, queries, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m")
def a16_retrieval_metrics(spark, d):
    return _metrics(spark, d).select("config_id", "query_class", "queries", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")))


@query(_sweep_sql() + " SELECT m.config_id, m.query_class, round(m.recall - b.recall, 6) + 0.0 AS d_recall, round(m.mrr - b.mrr, 6) + 0.0 AS d_mrr FROM m JOIN m b ON b.query_class = m.query_class AND b.config_id = 'base'")
def a17_config_sweep(spark, d):
    return V.deltas(_metrics(spark, d), "base").select("config_id", "query_class", (F.round("d_recall", 6) + 0.0).alias("d_recall"), (F.round("d_mrr", 6) + 0.0).alias("d_mrr"))


@query(_sweep_sql() + " SELECT DISTINCT query_id, asset_id FROM run WHERE rank <= 10 AND (query_id, asset_id) NOT IN (SELECT query_id, asset_id FROM qrels)")
def a18_judgment_pool(spark, d):
    judged = _qrels(spark, d).withColumn("model", F.lit("judge-1"))
    return V.judgment_pool(V.config_sweep(_legs(spark, d), _configs(spark)), judged, "judge-1")


@query(_sweep_sql() + ", a AS (SELECT *, 1.0 / (rank + 60) AS part FROM legs), b AS (SELECT *, 1.0 / (rank + 10) AS part FROM legs WHERE rank <= 20) SELECT query_id, asset_id, leg, a.rank AS rank_a, b.rank AS rank_b, b.rank - a.rank AS rank_delta, round(coalesce(b.part, 0) - coalesce(a.part, 0), 9) AS part_delta FROM a FULL JOIN b USING (query_id, asset_id, leg)")
def a19_leg_diagnosis(spark, d):
    legs = _legs(spark, d)
    one = lambda k, w: legs.filter(F.col("rank") <= w).select("query_id", "asset_id", "leg", F.col("rank").alias("leg_rank"), (1.0 / (F.col("rank") + k)).alias("part"))
    return V.leg_diagnosis(one(60, 1000), one(10, 20)).select("query_id", "asset_id", "leg", "rank_a", "rank_b", "rank_delta", F.round("part_delta", 9).alias("part_delta"))


# lookups


@query(f"WITH RECURSIVE {ED}, r AS (SELECT 'customer_7' AS n UNION SELECT dst FROM edges JOIN r ON src = n) SELECT n AS base_key FROM r WHERE n LIKE 'part%'")
def j01_in_scene(spark, d):
    e = X.edges(spark, d)
    parts = X.table(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("base_key"))
    return L.in_scene(parts, e, spark.createDataFrame([("customer_7",)], "root string"))


@query(f"WITH {A}, h AS (SELECT asset_id % 20 AS query_id, base_key, row_number() OVER (PARTITION BY asset_id % 20 ORDER BY asset_id) AS rank FROM assets) SELECT query_id, base_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM h WHERE base_key NOT LIKE '%/src1/%') WHERE r <= 5")
def j02_accessible(spark, d):
    from pyspark.sql import Window

    a = X.assets(spark, d)
    h = a.select((F.col("asset_id") % 20).alias("query_id"), "base_key", F.row_number().over(Window.partitionBy(F.col("asset_id") % 20).orderBy("asset_id")).alias("rank"))
    return L.accessible(h, a.filter("source <> 'src1'"), 5).select("query_id", "base_key")


@query(f"WITH {ED} SELECT DISTINCT src, dst FROM edges WHERE src NOT LIKE '%7' AND dst NOT LIKE '%7'")
def j03_accessible_graph(spark, d):
    e = X.edges(spark, d)
    nodes = G.all_nodes(e.select(F.col("src").alias("node")), e)
    return L.accessible_graph(nodes, e, nodes.filter("node not like '%7'"))[1].select("src", "dst").distinct()


@query(f"WITH {PS}, h AS (SELECT 'part_' || p_partkey AS base_key FROM part), f AS (SELECT source_asset_url AS base_key, count(*) AS n, min(scene_url || usd_path) AS f FROM prims GROUP BY 1) SELECT base_key, coalesce(n, 0) AS n_instances, least(coalesce(n, 0), 100) AS listed FROM h LEFT JOIN f USING (base_key)")
def j04_instances(spark, d):
    h = X.table(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("base_key"))
    return L.with_instances(h, X.prims(spark, d)).select("base_key", "n_instances", F.coalesce(F.size("instances"), F.lit(0)).cast("long").alias("listed"))


@query(f"WITH {PS}, h AS (SELECT DISTINCT 'scene_' || o_orderkey AS base_key FROM orders), m AS (SELECT scene_url AS base_key, list(usd_path ORDER BY usd_path) FILTER (root_prim) AS root_prims, min(usd_path) AS default_prim FROM prims GROUP BY 1) SELECT base_key, CASE WHEN m.default_prim IS NOT NULL THEN coalesce(root_prims, []) END AS root_prims, default_prim FROM h LEFT JOIN m USING (base_key)")
def j05_scene_prims(spark, d):
    h = X.table(spark, d, "orders").select(F.concat(F.lit("scene_"), F.col("o_orderkey").cast("string")).alias("base_key")).distinct()
    return L.with_scene_prims(h, X.prims(spark, d))


@query("SELECT doc_id AS asset_id, CASE WHEN 2 * doc_id < (SELECT count(*) FROM embeddings) THEN 'img_' || (2 * doc_id + CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END) END AS image FROM documents")
def j06_hit_images(spark, d):
    h = X.table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.when(F.col("doc_id") % 3 < 2, F.col("doc_id") % 3).cast("int").alias("view_offset"))
    return L.hit_images(h, X.asset_views(spark, d)).select("asset_id", "image")


@query("SELECT doc_id AS asset_id, (doc_id % 3)::INT AS view_offset, CASE WHEN ok THEN 'img_' || (2 * doc_id + doc_id % 3) END AS image, CASE WHEN NOT ok THEN 'no such view' END AS error FROM (SELECT *, 2 * doc_id < (SELECT count(*) FROM embeddings) AND doc_id % 3 < 2 AS ok FROM documents)")
def j07_image_by_offset(spark, d):
    h = X.table(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), (F.col("doc_id") % 3).cast("int").alias("view_offset"))
    return L.image_by_offset(h, X.asset_views(spark, d))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS exists FROM documents")
def j09_keys_exist(spark, d):
    return L.keys_exist(X.table(spark, d, "documents"), X.table(spark, d, "labels"), "doc_id")


@query("SELECT 'img_' || doc_id AS image FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def j10_orphans(spark, d):
    return L.orphans(X.table(spark, d, "documents").select(F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("image")), X.asset_views(spark, d))


@query(f"WITH {A} SELECT base_key AS uri, CASE WHEN asset_id % 10 = 0 THEN 'missing' ELSE 'unsupported' END AS reason FROM assets WHERE asset_id % 10 = 0 OR ext = 'mdl'")
def j11_reconcile(spark, d):
    a = X.assets(spark, d).withColumnRenamed("base_key", "uri")
    return L.reconcile(a, a.filter("asset_id % 10 <> 0"), F.col("ext") == "mdl")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS stale, round(100.0 * count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) / count(*), 6) AS percent FROM documents")
def j12_reconcile_cache(spark, d):
    return L.reconcile_cache(X.table(spark, d, "documents"), X.table(spark, d, "labels"), "doc_id")[1].withColumn("percent", F.round("percent", 6))


@query(f"WITH {A} SELECT base_key, 's3://bucket/' || source || '/' || lang || '/.thumbs/256x256/' || name || '.png' AS uri FROM assets WHERE asset_id % 2 = 0 UNION ALL SELECT base_key, 's3://bucket/' || source || '/' || lang || '/.thumbs/512x512/' || name || '.auto.png' FROM assets WHERE asset_id % 3 = 0")
def j13_thumbnails(spark, d):
    a = X.assets(spark, d)
    path = lambda r, s: F.concat(F.lit("s3://bucket/"), "source", F.lit("/"), "lang", F.lit(f"/.thumbs/{r}x{r}/"), "name", F.lit(f"{s}.png")).alias("uri")
    listing = a.filter("asset_id % 2 = 0").select(path(256, "")).union(a.filter("asset_id % 3 = 0").select(path(512, ".auto")))
    return L.thumbnails(a, listing).select("base_key", "uri")


@query(f"WITH {A} SELECT base_key, 's3://bucket/' || source || '/' || lang || '/.thumbs/' || name || '.7.png' AS uri FROM assets WHERE asset_id % 2 = 0")
def j13_thumbnails_by_pattern(spark, d):
    a = X.assets(spark, d)
    listing = a.filter("asset_id % 2 = 0").select(F.concat(F.lit("s3://bucket/"), "source", F.lit("/"), "lang", F.lit("/.thumbs/"), "name", F.lit(".7.png")).alias("uri"))
    return L.thumbnails_by_pattern(a, listing, r".*/\.thumbs/{name}\.\d\.png")


# windows and sets


@query("SELECT vec_id // 2 AS asset_id, arg_max(vec_id % 2, embedding[1])::INT AS best FROM embeddings GROUP BY 1")
def w03_best_element(spark, d):
    v = X.asset_views(spark, d).groupBy("asset_id").agg(F.collect_list(F.struct(F.col("embedding")[0].alias("s"), "view_offset")).alias("views"))
    return v.select("asset_id", F.array_max("views")["view_offset"].alias("best"))


@query(f"WITH {_ST} SELECT plugin, uri, status, ts::DOUBLE AS processing_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY plugin, uri ORDER BY ts DESC) AS r FROM st) WHERE r <= 5")
def w04_latest_history(spark, d):
    return L.latest_history(statuses(spark, d)).select("plugin", "uri", "status", "processing_timestamp")


@query(f"WITH {PR} SELECT k AS key, v AS value, count(*) AS n FROM props GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def w06_count_order(spark, d):
    return S.by_count(S.property_stats(X.prop_assets(spark, d)).filter("level = 'pairs'").select("key", "value", "n"))


@query("SELECT (event_id % 100) || '-' || event_id AS id FROM events ORDER BY event_id % 100, event_id")
def w07_stream_order(spark, d):
    return L.by_stream_id(X.table(spark, d, "events").select(F.concat((F.col("event_id") % 100).cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("id")))


@query("WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, 'stride' AS kind FROM n WHERE r % 7 = 0 AND r < 28 UNION ALL SELECT event_id, 'even' FROM n WHERE n <= 10 OR r IN (SELECT (i * n) // 10 FROM range(10) t(i))")
def w08_samples(spark, d):
    e = X.table(spark, d, "events").select("event_id", "user_id")
    return L.stride_sample(e, ["user_id"], "event_id", 7, 4).select("event_id", F.lit("stride").alias("kind")).unionByName(L.even_sample(e, ["user_id"], "event_id", 10).select("event_id", F.lit("even").alias("kind")))


@query("SELECT user_id, 70 AS n, least(count(*), 70) AS different FROM events GROUP BY 1")
def w09_resample(spark, d):
    r = L.resample(X.table(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id", 70)
    return r.groupBy("user_id").agg(F.count("*").cast("int").alias("n"), F.countDistinct("event_id").alias("different"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u02_difference(spark, d):
    return X.table(spark, d, "documents").select("doc_id").subtract(X.table(spark, d, "labels").select("doc_id"))


@query(f"WITH {ED} SELECT DISTINCT src, dst FROM edges")
def u03_edge_dedup(spark, d):
    return G.unique_edges(X.edges(spark, d)).select("src", "dst")


@query(f"WITH {ED} SELECT src AS node FROM edges UNION SELECT dst FROM edges UNION SELECT 'root'")
def u04_node_union(spark, d):
    e = X.edges(spark, d)
    return G.all_nodes(e.select(F.col("src").alias("node")), e, "root")
