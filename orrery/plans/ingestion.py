"""Queries of sources, sinks and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.sources import fixtures as X
from orrery.sources import ingest as I
from orrery.sources import tables as T

from orrery.functions.documents import deep_merge, document_changes, flatten_document

from .base import query

A, TG, CH = X.ASSETS, X.TAGS, X.CHANGES


def _listing(spark, d):
    return X.table(spark, d, "pages").select(F.col("url").alias("uri"), F.col("page_id").alias("size"))


@query("SELECT url AS uri FROM pages WHERE NOT suffix(url, '/') AND NOT regexp_matches(url, 'page=2|^http://') AND NOT regexp_matches(url, '/\\.[^/]')")
def s01_listing(spark, d):
    return I.filter_listing(_listing(spark, d), ["page=2", "^http://"]).select("uri")


@query()
def s01_list_files(spark, d):
    """The files of the data folder, from storage."""
    return I.list_assets(spark, d).select(F.substring_index("uri", "/", -1).alias("name"), "size")


@query("""WITH a AS (SELECT doc_id AS uri, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS uri, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE md5(text) END AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT uri, CASE WHEN a.h IS NULL THEN 'create' WHEN b.h IS NULL THEN 'delete' ELSE 'update' END AS event, coalesce(b.h, a.h) AS hash_value FROM a FULL JOIN b USING (uri) WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h""")
def s02_rescan(spark, d):
    x = X.table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.md5("text").alias("hash_value"))
    return I.rescan_as_changes(x.filter("uri % 5 <> 0"), x.filter("uri % 4 <> 0").withColumn("hash_value", F.when(F.col("uri") % 7 == 0, "new").otherwise(F.col("hash_value"))))


@query(f"WITH {A} SELECT base_key FROM assets WHERE regexp_matches(base_key, '^(?:s3://bucket/src1|s3://bucket/src2/en)') AND NOT regexp_matches(base_key, '^(?:.*png)')")
def s05_include_exclude(spark, d):
    return I.include_exclude(X.assets(spark, d), ["s3://bucket/src1", "s3://bucket/src2/en"], [".*png"], "base_key").select("base_key")


@query(f"WITH {A} SELECT base_key AS uri FROM assets WHERE ext IN ('usd', 'png') AND source <> 'src3' AND NOT contains(base_key, '/fr/') AND asset_id % 3 <> 0")
def s06_supported(spark, d):
    a = X.assets(spark, d)
    uri = F.when(F.col("source") == "src3", F.replace("base_key", F.lit("src3/"), F.lit(".git/"))).when(F.col("asset_id") % 3 == 0, F.replace("base_key", F.lit("doc_"), F.lit(".doc_"))).otherwise(F.col("base_key"))
    return I.supported(a.select(uri.alias("uri")), ["usd", "png"], excluded=["/fr/"])


@query(f"WITH {CH} SELECT 's3://b/x/' || uri || '.USD' AS base_key, '/x/' || uri || '.USD' AS path, uri || '.USD' AS name, 'usd' AS ext, size, hash_value FROM changes")
def s07_metadata(spark, d):
    c = X.changes(spark, d).withColumn("uri", F.concat(F.lit("s3://b/x/"), "uri", F.lit(".USD")))
    return I.asset_metadata(c).drop("ts")


def _scenes(spark, d):
    """Scene documents as JSON text, one per order."""
    p = X.prims(spark, d).filter("scene_mpu is not null")
    prim = F.struct("prim_type", "source_asset_url", F.col("polygon_count").cast("long").alias("polygon_count"))
    g = p.groupBy("scene_url").agg(F.min("usd_path").alias("default_prim_path"), F.first("scene_mpu").alias("scene_mpu"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("usd_path", prim)))).alias("prims"), F.array_sort(F.collect_set("source_asset_url")).alias("urls"))
    doc = F.struct("scene_url", "default_prim_path", "scene_mpu", F.lit("Y").alias("scene_up_axis"), F.transform("urls", lambda u: F.struct(u.alias("url"), F.lit(5).alias("size"))).alias("assets"), F.transform("urls", lambda u: F.struct(F.col("scene_url").alias("node_1_url"), u.alias("node_2_url"), F.lit("depends_on").alias("type"))).alias("asset_relationships"), "prims")
    return g.select(F.from_json(F.to_json(doc), I.SCENE).alias("s")).select("s.*")


@query(f"WITH {X.PRIMS} SELECT scene_url, usd_path, prim_type, source_asset_url, polygon_count::BIGINT AS polygon_count, scene_mpu, default_prim FROM prims")
def s08_ingest_prims(spark, d):
    return I.ingest_scenes(_scenes(spark, d))[2]


@query(f"WITH {X.PRIMS} SELECT DISTINCT scene_url AS src, source_asset_url AS dst, 'depends_on' AS type, scene_url FROM prims")
def s08_ingest_edges(spark, d):
    return I.ingest_scenes(_scenes(spark, d))[1]


@query(f"WITH {X.PRIMS} SELECT source_asset_url AS url, 5::BIGINT AS size FROM prims GROUP BY 1 UNION ALL SELECT scene_url, NULL FROM prims GROUP BY 1")
def s08_ingest_assets(spark, d):
    return I.ingest_scenes(_scenes(spark, d))[0]


@query("SELECT doc_id, source AS scene_url, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS version FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0")
def s09_replace_scene(spark, d):
    """Written twice to a partitioned table; the second time only two scenes."""
    x = X.table(spark, d, "documents").select("doc_id", F.col("source").alias("scene_url"), F.lit("old").alias("version"))
    path = I.scratch(spark, "scenes")
    I.replace_scenes(x, path)
    I.replace_scenes(x.filter("scene_url in ('src1', 'src2') and doc_id % 3 = 0").withColumn("version", F.lit("new")), path)
    return spark.read.schema(x.schema).parquet(path)


@query("SELECT doc_id, source AS scene_url, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS version FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0")
def s09_replace_rows(spark, d):
    x = X.table(spark, d, "documents").select("doc_id", F.col("source").alias("scene_url"), F.lit("old").alias("version"))
    return I.replace_rows(x, x.filter("scene_url in ('src1', 'src2') and doc_id % 3 = 0").withColumn("version", F.lit("new")))


def _state(spark, d):
    return X.table(spark, d, "documents").select("doc_id", "lang", "source")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id ELSE source END AS source FROM documents UNION ALL SELECT -1, 'xx', 's-1'")
def s10_upsert(spark, d):
    s = _state(spark, d)
    new = s.filter("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source"), F.lit(2).alias("v"))
    new = new.unionByName(new.withColumn("lang", F.lit("stale")).withColumn("v", F.lit(1))).unionByName(spark.createDataFrame([(-1, "xx", "s-1", 1)], new.schema))
    return T.upsert(s, T.latest(new, ["doc_id"], F.col("v")).drop("v"), "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents UNION ALL SELECT -1, 'xx', NULL")
def s11_update_meta(spark, d):
    s = _state(spark, d)
    return T.update_meta(s, s.filter("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang")).unionByName(spark.createDataFrame([(-1, "xx")], "doc_id long, lang string")), "doc_id")


@query("SELECT doc_id, lang AS a_x, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS a_y, CASE WHEN doc_id % 2 = 0 THEN 'z' END AS b_z FROM documents")
def s12_merge_nested(spark, d):
    s = _state(spark, d).select("doc_id", F.create_map(F.lit("a"), F.create_map(F.lit("x"), "lang", F.lit("y"), "source")).alias("m"))
    u = s.filter("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("a"), F.create_map(F.lit("y"), F.lit("new")), F.lit("b"), F.create_map(F.lit("z"), F.lit("z"))).alias("m"))
    return T.merge_nested(s, u, "doc_id", "m").select("doc_id", F.col("m")["a"]["x"].alias("a_x"), F.col("m")["a"]["y"].alias("a_y"), F.col("m")["b"]["z"].alias("b_z"))


_BASE = """json_object('lang', lang, 'n', n_chars, 'info', json_object('source', source, 'sizes', [n_chars, doc_id], 'deep', json_object('a', json_object('id', doc_id, 'keep', true), 'b', lang)))"""
_UPDATE = """json_object('info', json_object('sizes', [doc_id], 'deep', json_object('a', json_object('id', source, 'new', doc_id), 'b', json_object('now', 'object'))), 'lang', json_object('was', lang), 'added', json_object('x', json_object('y', n_chars)))"""
_LEAVES = {"lang": "lang", "was": "lang.was", "n": "n", "source": "info.source", "sizes": "info.sizes", "id": "info.deep.a.id", "keep": "info.deep.a.keep", "new": "info.deep.a.new", "b": "info.deep.b", "now": "info.deep.b.now", "y": "added.x.y"}
_EXTRACTS = ", ".join(f"m->>'$.{path}' AS {name}" for name, path in _LEAVES.items() if name not in ("lang", "b"))


def _documents(spark, d):
    return X.table(spark, d, "documents").select(
        "doc_id",
        F.to_json(F.struct("lang", F.col("n_chars").alias("n"), F.struct("source", F.array("n_chars", "doc_id").alias("sizes"), F.struct(F.struct(F.col("doc_id").alias("id"), F.lit(True).alias("keep")).alias("a"), F.col("lang").alias("b")).alias("deep")).alias("info"))).alias("m"),
        F.to_json(F.struct(F.struct(F.array("doc_id").alias("sizes"), F.struct(F.struct(F.col("source").alias("id"), F.col("doc_id").alias("new")).alias("a"), F.struct(F.lit("object").alias("now")).alias("b")).alias("deep")).alias("info"), F.struct(F.col("lang").alias("was")).alias("lang"), F.struct(F.struct(F.col("n_chars").alias("y")).alias("x")).alias("added"))).alias("u"),
    )


@query(f"WITH t AS (SELECT doc_id, {_BASE} AS m FROM documents WHERE doc_id % 5 <> 0), u AS (SELECT doc_id, {_UPDATE} AS u FROM documents WHERE doc_id % 2 = 0), j AS (SELECT doc_id, CASE WHEN m IS NULL THEN u WHEN u IS NULL THEN m ELSE json_merge_patch(m, u) END AS m FROM t FULL JOIN u USING (doc_id)) SELECT doc_id, {_EXTRACTS} FROM j")
def s12_merge_documents(spark, d):
    """Documents of four levels: nested keys, lists, scalars that become objects, new keys, and updates of rows that aren't there."""
    docs = _documents(spark, d)
    merged = T.merge_nested(docs.filter("doc_id % 5 <> 0").select("doc_id", "m"), docs.filter("doc_id % 2 = 0").select("doc_id", F.col("u").alias("m")), "doc_id", "m")
    return merged.select("doc_id", *(F.get_json_object("m", f"$.{path}").alias(name) for name, path in _LEAVES.items() if name not in ("lang", "b")))


@query(f"WITH j AS (SELECT doc_id, json_merge_patch({_BASE}, {_UPDATE}) AS m FROM documents), k AS (SELECT doc_id, unnest(['lang__was', 'n', 'info__source', 'info__sizes', 'info__deep__a__id', 'info__deep__a__keep', 'info__deep__a__new', 'info__deep__b__now', 'added__x__y']) AS key, m FROM j) SELECT doc_id, key, m->>('$.' || replace(key, '__', '.')) AS value FROM k")
def f19_flatten_documents(spark, d):
    """Flattened keys of merged documents of four levels."""
    flat = flatten_document(deep_merge(F.parse_json("m"), F.parse_json("u")))
    return _documents(spark, d).select("doc_id", F.explode(flat).alias("key", "v")).select("doc_id", "key", F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")).alias("value"))


@query(f"WITH j AS (SELECT doc_id, {_BASE} AS a, json_merge_patch({_BASE}, {_UPDATE}) AS b FROM documents), k AS (SELECT doc_id, unnest(['lang', 'lang__was', 'n', 'info__source', 'info__sizes', 'info__deep__a__id', 'info__deep__a__keep', 'info__deep__a__new', 'info__deep__b', 'info__deep__b__now', 'added__x__y']) AS key, a, b FROM j), v AS (SELECT doc_id, key, a->('$.' || replace(key, '__', '.')) AS o, b->('$.' || replace(key, '__', '.')) AS n FROM k) SELECT doc_id, key, o::VARCHAR AS old, CASE WHEN json_type(n) = 'OBJECT' THEN NULL ELSE n::VARCHAR END AS new FROM v WHERE o IS DISTINCT FROM CASE WHEN json_type(n) = 'OBJECT' THEN NULL ELSE n END")
def s12_changes(spark, d):
    """What each merge changes, by flattened key."""
    docs = _documents(spark, d).select("doc_id", F.explode(document_changes(F.parse_json("m"), F.parse_json("u"))).alias("c"))
    return docs.select("doc_id", "c.key", "c.old", "c.new")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s13_delete(spark, d):
    return T.delete_items(_state(spark, d), X.table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, lang, source FROM documents UNION ALL SELECT doc_id + 1000000, lang, source FROM documents WHERE doc_id % 10 = 0")
def s14_copy(spark, d):
    s = _state(spark, d)
    return T.copy_items(s, s.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1000000).alias("dst")), "doc_id")


@query("SELECT DISTINCT vec_id // 2 AS asset_id FROM embeddings WHERE label = 3")
def s15_scan_keys(spark, d):
    v = X.asset_views(spark, d).groupBy("asset_id").agg(F.collect_list("label").alias("labels"))
    return T.scan_keys(v, "asset_id", F.array_contains("labels", "3"))


@query(r"""SELECT DISTINCT 's3://b/' || source || '/m.mdl' AS src, unnest(['s3://b/' || source || '/tex/' || lang || '.png', 's3://b/base.mdl']) AS dst FROM documents""")
def s17_material_references(spark, d):
    x = X.table(spark, d, "documents")
    content = F.concat(F.lit('import x; texture_2d("./tex/'), "lang", F.lit('.png", gamma); using "../base.mdl"; self("m.mdl"); note("no reference");'))
    return I.material_references(x.select(F.concat(F.lit("s3://b/"), "source", F.lit("/m.mdl")).alias("url"), content.alias("content")))


@query("SELECT l.doc_id, d.lang, d.doc_id IS NOT NULL AS found FROM (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)")
def s18_get_items(spark, d):
    return T.get_items(_state(spark, d), X.table(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id")), "doc_id", exclude=["source"])


def _tags(spark, d):
    return X.tag_assets(spark, d).select(F.concat(F.lit("/a/"), F.col("asset_id").cast("string")).alias("path"), F.explode("tags").alias("t")).select("path", "t.namespace", "t.tag", "t.value")


_T = "t AS (SELECT '/a/' || doc_id AS path, 'appearance' AS namespace, tag, value, doc_id FROM (SELECT doc_id, 'quality' AS tag, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels))"


@query(f"""WITH {_T} SELECT path, namespace, tag, CASE WHEN tag = 'quality' AND doc_id % 4 = 1 THEN 'set' ELSE value END AS value FROM t WHERE doc_id % 4 <> 0 AND NOT (tag = 'toxic' AND doc_id % 4 = 2)
UNION ALL SELECT '/a/' || doc_id, 'appearance', 'fresh', 'r' FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT '/a/' || doc_id, 'appearance', 'extra', 'x' FROM labels WHERE doc_id % 4 = 3""")
def t01_tag_actions(spark, d):
    p = X.table(spark, d, "labels").select("doc_id", F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("path"))
    act = lambda seq, m, tag, value, action: p.filter(F.col("doc_id") % 4 == m).select(F.lit(seq).alias("seq"), "path", F.lit("appearance").alias("namespace"), F.lit(tag).alias("tag"), F.lit(value).alias("value"), F.lit(action).alias("action"))
    actions = act(1, 0, "fresh", "r", "reset").unionByName(act(1, 1, "quality", "set", "set")).unionByName(act(1, 2, "toxic", None, "remove")).unionByName(act(1, 3, "quality", "ignored", "add")).unionByName(act(2, 3, "extra", "x", "add")).unionByName(act(3, 1, " ", "x", "set"))
    return I.apply_tag_actions(_tags(spark, d), actions)


@query(f"WITH {_T} SELECT path, namespace, tag, value FROM t WHERE doc_id % 2 = 1")
def t02_clear_namespaces(spark, d):
    t = _tags(spark, d)
    return I.clear_namespaces(t, t.filter(F.substring_index("path", "/", -1).cast("long") % 2 == 0), ["appearance"])


@query(f"WITH {_T} SELECT DISTINCT path FROM t WHERE tag = 'toxic' AND starts_with(path, '/a/1')")
def t03_tagged_paths(spark, d):
    return I.tagged_paths(_tags(spark, d), "toxic", "appearance", "/a/1")


@query(f"WITH {_T} SELECT path, namespace, tag, value FROM t UNION ALL SELECT path, 'user', tag, value FROM t")
def t04_copy_tags(spark, d):
    return I.copy_tags(_tags(spark, d), "appearance", "user")
