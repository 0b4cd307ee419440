"""Queries of the functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import exprs as E
from orrery.operators import predicates as P
from orrery.sources import fixtures as X

from .base import query

A, V, PR, TG = X.ASSETS, X.VIEWS, X.PROPS, X.TAGS


def _keys(df):
    return df.select("asset_id")


def _p(name: str, where: str, condition, source=X.assets, with_sql: str = A, table: str = "assets"):
    def run(spark, d):
        return _keys(source(spark, d).filter(condition()))

    run.__name__ = name
    query(f"WITH {with_sql} SELECT asset_id FROM {table} WHERE {where}")(run)


_p("p01_wildcard_name", r"regexp_matches(name, '(?is)^doc_1.*\.png$|^doc_.\.usd$') AND regexp_matches(name, '(?is)^.*[02468]\..*$|^doc_.*$')", lambda: P.wildcard_include(F.col("name"), "DOC_1*.png,doc_?.usd;*,doc_*"))
_p("p02_wildcard_exclude", r"NOT regexp_matches(name, '(?is)^doc_1.*$') AND NOT regexp_matches(name, '(?is)^.*\.mdl$')", lambda: P.wildcard_exclude(F.col("name"), "doc_1*;*.mdl"))
_p("p03_extension", "ext IN ('usd', 'png') AND ext <> 'png' OR ext IN ('jpg')", lambda: (P.extension_include(F.col("ext"), ".usd,png") & P.extension_exclude(F.col("ext"), ".png")) | P.extension_include(F.col("ext"), "J?G"))
_p("p04_dates", "created_timestamp >= TIMESTAMP '2024-01-03' AND created_timestamp < TIMESTAMP '2024-01-11' AND modified_timestamp <= TIMESTAMP '2024-01-08 12:00:00'", lambda: P.date_range(F.col("created_timestamp"), "20240103", "2024-01-10") & P.date_range(F.col("modified_timestamp"), before="2024-01-08T12:00:00"))
_p("p05_size", "size >= 1048576 AND size <= 4 * 1048576", lambda: P.size_range(F.col("size"), "1MB", "4MB"))
_p("p06_path", r"regexp_matches(base_key, '(?is)^.*src1.*/en/.*$') AND NOT regexp_matches(base_key, '(?is)^.*src12.*$')", lambda: P.path_contains(F.col("base_key"), "SRC1*/en/") & P.path_excludes(F.col("base_key"), "src12"))
_p("p07_users", "created_by = 'src1' OR modified_by <> 'en'", lambda: P.user_is(F.col("created_by"), "src1") | P.user_is_not(F.col("modified_by"), "en"))
_p("p08_url_regexp", r"regexp_full_match(base_key, 's3://bucket/src[0-9]/.*') AND NOT regexp_full_match(base_key, '.*\.mdl')", lambda: P.url_regexp(F.col("base_key"), "s3://bucket/src[0-9]/.*") & P.url_regexp(F.col("base_key"), r"~(.*\.mdl)"))
_P_SQL = "SELECT asset_id FROM props GROUP BY 1 HAVING "


def _props(name: str, having: str, condition):
    def run(spark, d):
        return _keys(X.prop_assets(spark, d).filter(condition()))

    run.__name__ = name
    query(f"WITH {PR} {_P_SQL}{having}")(run)


_props("p09_properties_all", "bool_or(k = 'brand' AND v = 'Brand#2') AND bool_or(k = 'type' AND v ILIKE 'ECON%')", lambda: P.properties_all(F.col("props"), 'brand=Brand#2,"type=~econ*",ignored'))
_props("p10_properties_any", "bool_or(k = 'brand' AND v = 'Brand#2') OR bool_or(v = 'PROMO')", lambda: P.properties_any(F.col("props"), "brand=Brand#2,=PROMO"))
_props("p11_properties_none", "NOT bool_or(k = 'brand' AND v ILIKE 'Brand#1%')", lambda: P.properties_none(F.col("props"), "brand=~brand#1*"))
_props("p12_properties_numeric", "bool_or(k = 'size' AND n >= 10) AND bool_or(k = 'retail' AND n < 950.5)", lambda: P.properties_numeric(F.col("props"), "size>=10,retail<950.5"))
_p("p13_tags", "tag = 'quality' AND value = '1' GROUP BY 1", lambda: P.tags_all(F.col("tags"), "QUAL*=1,toxic="), X.tag_assets, TG, "tags")
_p("p14_metadata", "lang = 'en' AND source = 'src3'", lambda: P.metadata_matches(F.col("vlm"), "language=EN,origin=src3"), X.vlm_assets)


@query(f"WITH {X.PRIMS} SELECT scene_url, usd_path FROM prims WHERE (max_x - min_x) * scene_mpu >= 0.01 AND (max_y - min_y) * scene_mpu <= 0.02 AND (max_x - min_x) * scene_mpu <= 0.0101")
def p15_dimensions(spark, d):
    p = X.prims(spark, d)
    scaled = lambda a: (F.col(f"max_{a}") - F.col(f"min_{a}")) * F.col("scene_mpu")
    return p.filter(P.dimension_range(scaled("x"), 0.01, 0.0101) & P.dimension_range(scaled("y"), most=0.02)).select("scene_url", "usd_path")


@query(f"WITH {A} SELECT asset_id FROM assets WHERE base_key IN (SELECT base_key FROM assets WHERE size > 2000000)")
def p16_url_whitelist(spark, d):
    a = X.assets(spark, d)
    return _keys(P.url_whitelist(a, a.filter("size > 2000000").select(F.col("base_key").alias("url"))))


@query("SELECT vec_id // 2 AS asset_id FROM embeddings GROUP BY 1 HAVING bool_or(label = 1) AND NOT bool_or(label = 2)")
def p17_view_keywords(spark, d):
    v = X.asset_views(spark, d).groupBy("asset_id").agg(F.collect_list(F.struct("view_offset", "keyword")).alias("views"))
    return _keys(v.filter(P.views_keyword(F.col("views"), ["1"], ["2"])))


_p("p18_key_filter", "starts_with(base_key, 's3://bucket/src1') AND contains(base_key, '/fr/') AND (suffix(base_key, '.png') OR suffix(base_key, '.usd'))", lambda: P.key_filter(F.col("base_key"), "s3://bucket/src1") & P.key_filter(F.col("base_key"), "/fr/", "contains") & (P.key_filter(F.col("base_key"), ".png", "suffix") | P.key_filter(F.col("base_key"), ".usd", "suffix")))
_p("p19_under_path", "source = 'src2' AND lang = 'de'", lambda: P.under_path(E.path_prefixes(F.col("path")), "/src2/de/"))


@query(f"WITH {A} SELECT base_key, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY base_key) AS rank FROM assets WHERE ext = 'png'")
def p20_filter_only(spark, d):
    return P.filter_only(X.assets(spark, d), F.col("ext") == "png").select("base_key", "score", "rank")


def _parsed(spark, d):
    b = X.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("pos"), "source", "doc_id", "n_chars")
    pick = F.element_at(F.array(*map(F.lit, ("name", "size", "created", "weight", "colour", "brand"))), (F.col("doc_id") % 6 + 1).cast("int"))
    op = F.element_at(F.array(*map(F.lit, ("=", ">=", "~"))), (F.col("doc_id") % 3 + 1).cast("int"))
    value = F.when(pick == "size", F.concat((F.col("n_chars") % 7).cast("string"), F.lit("MB"))).when(pick == "created", F.lit("2024-01-02")).when(pick == "weight", (F.col("n_chars") % 9).cast("string")).otherwise(F.col("source"))
    return b.select("query_id", "pos", pick.alias("field"), op.alias("operator"), value.alias("value"))


_PARSED = "parsed AS (SELECT query_id, pos, field, operator, CASE field WHEN 'size' THEN (n_chars % 7) || 'MB' WHEN 'created' THEN '2024-01-02' WHEN 'weight' THEN (n_chars % 9)::VARCHAR ELSE source END AS value FROM (SELECT doc_id % 50 AS query_id, doc_id AS pos, ['name', 'size', 'created', 'weight', 'colour', 'brand'][(doc_id % 6 + 1)::INT] AS field, ['=', '>=', '~'][(doc_id % 3 + 1)::INT] AS operator, source, n_chars FROM documents))"
_REASON = "judged AS (SELECT *, CASE WHEN field = 'colour' THEN 'unknown field' WHEN NOT list_contains(CASE field WHEN 'name' THEN ['=', '~'] WHEN 'brand' THEN ['=', '~'] WHEN 'weight' THEN ['>=', '<=', '>', '<', '='] ELSE ['>=', '<='] END, operator) THEN 'unsupported operator' END AS reason FROM parsed)"


@query(f"""WITH {_PARSED}, {_REASON}, f AS (SELECT query_id, pos, CASE field WHEN 'name' THEN 'file_name' WHEN 'brand' THEN 'filter_by_properties' WHEN 'weight' THEN 'filter_by_properties_numeric' WHEN 'size' THEN 'file_size_greater_than' ELSE 'created_after' END AS param,
  CASE field WHEN 'brand' THEN 'brand' || CASE operator WHEN '~' THEN '=~' ELSE '=' END || value WHEN 'weight' THEN 'weight' || operator || value ELSE value END AS fragment FROM judged WHERE reason IS NULL)
SELECT query_id, param, CASE WHEN param = 'file_name' OR param LIKE 'filter%' THEN string_agg(fragment, ',' ORDER BY pos) ELSE last(fragment ORDER BY pos) END AS value FROM f GROUP BY query_id, param""")
def p21_filter_mapping(spark, d):
    return P.map_filters(_parsed(spark, d), P.field_registry(spark))[0]


@query(f"WITH {_PARSED}, {_REASON} SELECT query_id, pos, field, operator, value, reason FROM judged WHERE reason IS NOT NULL")
def p21_filters_dropped(spark, d):
    return P.map_filters(_parsed(spark, d), P.field_registry(spark))[1].filter("reason is not null")


# functions


@query(r"SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS standard, regexp_extract_all(lower(text), '\pL+') AS simple, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS n_whitespace, [source] AS keyword FROM documents")
def f02_analyzers(spark, d):
    t = F.col("text")
    return X.table(spark, d, "documents").select("doc_id", E.standard_tokens(t).alias("standard"), E.simple_tokens(t).alias("simple"), F.size(E.whitespace_tokens(t)).alias("n_whitespace"), E.keyword_tokens(F.col("source")).alias("keyword"))


@query(f"WITH {A} SELECT asset_id, ['/' || source, '/' || source || '/' || lang, path] AS prefixes, [source || '/' || lang || '/' || name, lang || '/' || name, name] AS suffixes FROM assets")
def f03_path_tokens(spark, d):
    return X.assets(spark, d).select("asset_id", E.path_prefixes(F.col("path")).alias("prefixes"), E.path_suffixes(F.col("path")).alias("suffixes"))


_PAIRS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


@query(f"WITH {_PAIRS} SELECT vec_id, round(1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) AS distance, round((1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y))) / 2, 6) AS half, round(1 / (1 + exp(-(108.33 * list_inner_product(x, y) - 15.98))), 6) AS probability, round(x[1] / sqrt(list_inner_product(x, x)), 6) AS unit FROM p")
def f04_vectors(spark, d):
    """F4 to F7."""
    v = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    return p.select("vec_id", F.round(E.cosine_distance(x, y), 6).alias("distance"), F.round(E.half_cosine_distance(x, y), 6).alias("half"), F.round(E.match_probability(E.dot(x, y)), 6).alias("probability"), F.round(E.l2_normalize(x)[0], 6).alias("unit"))


@query("SELECT o_orderkey, list_transform(a, lambda x: round(exp(x - list_max(a)) / list_sum(list_transform(a, lambda y: exp(y - list_max(a)))), 6)) AS p FROM (SELECT o_orderkey, [o_totalprice / 100000, o_custkey / 1000.0, 1.0]::DOUBLE[] AS a FROM orders)")
def f08_softmax(spark, d):
    a = F.array(F.col("o_totalprice") / 100000, F.col("o_custkey") / 1000.0, F.lit(1.0))
    return X.table(spark, d, "orders").select("o_orderkey", F.transform(E.softmax(a), lambda x: F.round(x, 6)).alias("p"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/' || split_part(split_part(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), '?', 1), '/', 2) || '/tex/a.png?v=1' AS up, 's3://x/y' AS absolute, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/abs/z.mdl' AS rooted FROM pages")
def f09_normalize_url(spark, d):
    u = F.regexp_replace("url", r"([^/])/([a-z]{2})/.*$", "$1/$2/dir/page.html")
    return X.table(spark, d, "pages").select("page_id", E.normalize_url(u, F.lit("..\\.\\tex/b/../a.png?v=1")).alias("up"), E.normalize_url(u, F.lit("s3://x/y")).alias("absolute"), E.normalize_url(u, F.lit("/abs/./z.mdl")).alias("rooted"))


@query(f"WITH {A} SELECT asset_id, ext AS extension, name AS basename, 's3://bucket/' || source || '/' || lang AS dirname FROM assets")
def f10_path_parts(spark, d):
    k = F.col("base_key")
    return X.assets(spark, d).select("asset_id", E.extension(k).alias("extension"), E.basename(k).alias("basename"), E.dirname(k).alias("dirname"))


@query("SELECT doc_id, (n_chars % 100) * [1024, 1048576, 1073741824, 1099511627776][(doc_id % 4 + 1)::INT] AS bytes, round(100.0 * (n_chars % 100) / greatest(doc_id::DOUBLE, 1e-9), 6) AS percent, TRUE AS valid, NULL::BIGINT AS bad FROM documents")
def f11_sizes(spark, d):
    """F11, F12 and F30."""
    text = F.concat((F.col("n_chars") % 100).cast("string"), F.element_at(F.array(*map(F.lit, "KMGT")), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("B"))
    return X.table(spark, d, "documents").select("doc_id", E.size_bytes(text).alias("bytes"), F.round(E.percentage(F.col("n_chars") % 100, F.col("doc_id")), 6).alias("percent"), E.valid_size(text).alias("valid"), E.size_bytes(F.lit("10 MB")).alias("bad"))


@query(f"WITH {PR} SELECT k, CASE k WHEN 'size' THEN 'number' WHEN 'retail' THEN 'number' ELSE 'string' END AS kind FROM props GROUP BY 1")
def f13_infer_type(spark, d):
    p = X.prop_assets(spark, d).select(F.explode("props").alias("p"))
    return p.groupBy(F.col("p.name").alias("k")).agg(E.infer_value_type(F.col("p.value")).alias("kind"))


@query(f"WITH {PR} SELECT asset_id, k, v, t, n FROM props")
def f14_format_property(spark, d):
    """types and numbers found again from the text values."""
    p = X.prop_assets(spark, d).select("asset_id", F.explode("props").alias("p"))
    q = E.format_property(F.col("p.name"), F.col("p.value"))
    return p.select("asset_id", q["name"].alias("k"), q["value"].alias("v"), q["value_type"].alias("t"), q["value_numeric"].alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(-3.4028234663852886e38, least(3.4028234663852886e38, CASE WHEN l_linenumber = 1 THEN 1e300 WHEN l_linenumber = 2 THEN -1e300 ELSE l_quantity END)) AS clamped FROM lineitem")
def f16_clamp(spark, d):
    x = F.when(F.col("l_linenumber") == 1, 1e300).when(F.col("l_linenumber") == 2, -1e300).otherwise(F.col("l_quantity"))
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.clamp(x).alias("clamped"))


@query("""SELECT p_partkey, p_type AS kept, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '{"semantic:Semantics_' || p_size || '":"' || p_brand || '"}' ELSE '{"semantic:Semantics_' || least(p_size::VARCHAR, 'x') || '":"' || CASE WHEN p_size::VARCHAR < 'x' THEN p_brand ELSE p_name END || '","semantic:Semantics_x":"' || p_name || '"}' END AS labels, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 2 END AS n_keys FROM part""")
def f18_semantic_labels(spark, d):
    """F18 with no, one and two labels; other keys stay."""
    size = F.col("p_size")
    label = F.concat(F.lit("semantic:Semantics_"), size.cast("string"))
    none = F.create_map().cast("map<string,string>")
    labels = F.when(size % 3 == 0, none).when(size % 3 == 1, F.create_map(label, "p_brand")).otherwise(F.create_map(F.lit("semantic:Semantics_x"), "p_name", label, "p_brand"))
    base = F.map_concat(F.create_map(F.lit("type"), "p_type"), labels)
    c = E.semantic_label_cleanup(F.when(size % 3 == 0, F.map_concat(base, F.create_map(F.lit("semantic"), "p_name"))).otherwise(base))
    return X.table(spark, d, "part").select("p_partkey", c["type"].alias("kept"), c["semantic_labels"].alias("labels"), F.size(c).alias("n_keys"))


@query("""SELECT p_partkey, 'x' AS kept, '{"semantic:Semantics_a":"' || p_brand || '","semantic:Semantics_b":"' || p_type || '"}' AS labels, ['a__x', 'a__y'] AS flat, regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') AS slug, 'my_file_name_2' AS camel FROM part""")
def f18_maps(spark, d):
    """F18 to F20."""
    m = F.create_map(F.lit("semantic:Semantics_b"), F.col("p_type"), F.lit("keep"), F.lit("x"), F.lit("semantic:Semantics_a"), F.col("p_brand"))
    c = E.semantic_label_cleanup(m)
    flat = E.flatten_keys(F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.col("p_brand"), F.lit("y"), F.col("p_type"))))
    return X.table(spark, d, "part").select("p_partkey", c["keep"].alias("kept"), c["semantic_labels"].alias("labels"), F.map_keys(flat).alias("flat"), E.slug(F.col("p_type")).alias("slug"), E.slug(F.lit("myFileName -- 2")).alias("camel"))


@query("SELECT p_partkey, [p_brand, p_type] AS tags, [0.95, 1.0]::DOUBLE[] AS probs, [p_brand, p_type] AS back, p_brand || ', ' || p_type AS joined, [p_brand, p_type] AS appended, ['a b', p_type] AS quoted FROM part")
def f21_lists(spark, d):
    """F21 to F23 and F28."""
    labels = E.parse_label_string(F.concat("p_brand", F.lit(" (95%), "), "p_type"))
    rows = E.columns_to_rows(n=F.array("p_brand", "p_type"), k=F.array(F.lit(1), F.lit(2)))
    quoted = E.quoted_list(F.concat(F.lit('"a b", '), "p_type", F.lit(", ")))
    return X.table(spark, d, "part").select("p_partkey", labels["tag"].alias("tags"), labels["prob"].alias("probs"), E.rows_to_columns(rows, "n").alias("back"), E.combine_strings(F.col("p_brand"), F.col("p_type")).alias("joined"), E.combine_lists(F.array("p_brand"), F.array("p_type")).alias("appended"), quoted.alias("quoted"))


@query("SELECT event_id, strftime(date_trunc('milliseconds', ts), '%Y-%m-%d %H:%M:%S.%g') AS text, (epoch_us(ts) // 1000) / 1000.0 AS seconds, sha256(props) AS hash, TRUE AS valid, FALSE AS invalid FROM events")
def f24_dates(spark, d):
    """F24, F25 and F30."""
    s = F.unix_millis(F.col("ts").cast("timestamp")) / 1000.0
    return X.table(spark, d, "events").select("event_id", E.date_from_timestamp(s).alias("text"), E.date_to_timestamp(E.date_from_timestamp(s)).alias("seconds"), E.content_hash(F.col("props")).alias("hash"), E.valid_date(F.date_format("ts", "yyyyMMdd")).alias("valid"), E.valid_date(F.lit("yesterday")).alias("invalid"))


@query(f"WITH {A} SELECT asset_id, lang || '/' || name AS inside, 'a/_/b' AS safe FROM assets")
def f26_archive_path(spark, d):
    return X.assets(spark, d).select("asset_id", E.archive_path(F.col("base_key"), F.concat(F.lit("s3://bucket/"), "source", F.lit("/"))).alias("inside"), E.archive_path(F.lit("s3://a/../b"), F.lit("")).alias("safe"))


@query("SELECT doc_id, n AS name, CASE n WHEN 'lang' THEN [lang] WHEN 'parts' THEN [source, 'x'] WHEN 'ok' THEN []::VARCHAR[] ELSE ['a', 'b'] END AS value_text, CASE n WHEN 'ok' THEN n_chars > 1000 END AS value_bool FROM documents, (VALUES ('lang'), ('parts'), ('ok'), ('arr')) v(n)")
def f27_metadata_rows(spark, d):
    j = F.concat(F.lit('{"lang":"'), "lang", F.lit('","parts":"'), "source", F.lit(', x","ok":'), (F.col("n_chars") > 1000).cast("string"), F.lit(',"arr":["a","b"],"obj":{"q":1},"no":null}'))
    return X.table(spark, d, "documents").select("doc_id", F.inline(E.metadata_rows(j)))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS n_user, 1 AS n_generated FROM labels")
def f29_tag_namespaces(spark, d):
    lab = X.table(spark, d, "labels")
    tags = F.filter(F.array(F.struct(F.lit("good").alias("tag"), F.when(F.col("quality") == 1, "look").otherwise("other").alias("namespace")), F.struct(F.lit("auto").alias("tag"), F.lit(".look.generated").alias("namespace"))), lambda t: t["namespace"].isNotNull())
    return lab.select("doc_id", F.size(E.tags_in(tags, "look")).alias("n_user"), F.size(E.tags_in(tags, "look", "generated")).alias("n_generated"))
