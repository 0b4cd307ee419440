"""Queries of ranked retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.exprs import standard_tokens
from orrery.operators import retrieval as R
from orrery.sources import fixtures as X

from .base import query

A, V = X.ASSETS, X.VIEWS


def text_queries(spark, d):
    return X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark, d):
    """The stored vectors of vec_id 0 to 19 are a table of queries."""
    return X.table(spark, d, "embeddings").filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _bm25(where: str = "TRUE") -> str:
    return rf"""{A}, tok AS (SELECT asset_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS t FROM assets WHERE {where}), p AS (SELECT asset_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT asset_id, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY 1, 2),
 st AS (SELECT count(DISTINCT asset_id) AS docs, sum(tf) / count(DISTINCT asset_id) AS mean FROM p), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term FROM benchmark),
 text_leg AS (SELECT query_id, asset_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


_VECTOR = f"{V}, vq AS (SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id < 20), ip AS (SELECT query_id, asset_id, max(list_inner_product(embedding::DOUBLE[], vector::DOUBLE[])) AS ip FROM asset_views, vq GROUP BY 1, 2)"


def _rank(leg: str, name: str, size: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, asset_id) AS rank FROM {leg}) WHERE rank <= {size})"


@query(f"WITH {_bm25()} SELECT query_id, asset_id, round(score, 6) AS score FROM text_leg")
def r02_bm25(spark, d):
    terms = R.query_terms(text_queries(spark, d)).select("query_id", "term", F.col("term").alias("word"), F.lit(1.0).alias("boost"))
    return R.bm25(R.field_tokens(X.assets(spark, d), R.Field(F.col("text"))), terms).select("query_id", "asset_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25()}, w AS (SELECT 1000 + l AS query_id, asset_id, 0.5 AS score FROM assets, (VALUES (1, 'doc_1'), (2, 'png')) v(l, t) WHERE contains(lower(name), t)), w2 AS (
  SELECT query_id, asset_id, 2 * score AS score FROM text_leg UNION ALL SELECT * FROM w)
SELECT query_id, asset_id, round(sum(score), 6) AS score FROM w2 GROUP BY 1, 2""")
def r01_text_leg(spark, d):
    """The body's match clause at weight 2 for the benchmark, the name's wildcard clause at 0.5 for two more queries; the SQL numbers these 1001 and 1002 and adds up what items of the same number match."""
    assets = X.assets(spark, d)
    wild = spark.createDataFrame([(1001, "DOC_1"), (1002, "png")], "query_id long, text string")
    body = R.text_leg(assets, text_queries(spark, d), {"text": (F.col("text"), 2.0, 0.0)})
    leg = body.unionByName(R.text_leg(assets, wild, {"name": (F.col("name"), 0.0, 0.5)})).drop("fields").groupBy("query_id", "asset_id").agg(F.sum("score").alias("score"))
    return leg.select("query_id", "asset_id", F.round("score", 6).alias("score"))


def _clause(name: str, tokens: str, queries: str, operator: str = "or") -> str:
    """SQL of one match clause: tokens(id, e, t) by field element, queries(query_id, term); BM25 over elements, summed by id."""
    return f"""{name}_tok AS ({tokens}), {name}_p AS (SELECT id, e, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, e, len(t) AS n, unnest(t) AS term FROM {name}_tok) GROUP BY ALL),
 {name}_st AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM {name}_tok WHERE len(t) > 0), {name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1), {name}_q AS ({queries}), {name}_n AS (SELECT query_id, count(DISTINCT term) AS wanted FROM {name}_q GROUP BY 1),
 {name} AS (SELECT query_id, id, sum(score) AS score FROM (SELECT query_id, id, e, count(DISTINCT term) AS terms, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_df USING (term), {name}_st GROUP BY ALL) JOIN {name}_n USING (query_id) WHERE {"terms = wanted" if operator == "and" else "TRUE"} GROUP BY 1, 2)"""


_PARTS = [_clause("nm", r"SELECT p_partkey AS id, 0 AS e, regexp_extract_all(lower(p_name), '[\pL\pN_]+') AS t FROM part", r"SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name), '[\pL\pN_]+')) AS term FROM part WHERE p_partkey < 12", "and"), _clause("pr", r"SELECT id, e, regexp_extract_all(lower(v), '[\pL\pN_]+') AS t FROM (SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS e, unnest([p_brand, p_type, p_size::VARCHAR, p_retailprice::VARCHAR]) AS v FROM part)", r"SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_size), '[\pL\pN_]+')) AS term FROM part WHERE p_partkey < 12"), _clause("kw", "SELECT p_partkey AS id, 0 AS e, [p_name] AS t FROM part", "SELECT p_partkey AS query_id, p_name AS term FROM part WHERE p_partkey < 12")]


@query(f"WITH {', '.join(_PARTS)}, u AS (SELECT query_id, id, 3 * score AS score, 'name' AS f FROM nm UNION ALL SELECT query_id, id, 0.5 * score, 'props' FROM pr UNION ALL SELECT query_id, id, score, 'exact' FROM kw) SELECT query_id, id AS asset_id, f AS field, round(score, 6) AS score FROM u")
def r01_clauses(spark, d):
    """Match clauses one by one: all terms in the name, any in nested properties (summed over them), the whole name as one keyword."""
    parts, part = X.prop_assets(spark, d), X.table(spark, d, "part").filter("p_partkey < 12")
    keyword = lambda c: F.array(c)
    names = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    more = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("text"))
    legs = [R.text_leg(parts, q, {n: f}) for q, n, f in ((names, "name", R.Field(F.col("name"), 3.0, operator="and")), (more, "props", R.Field(F.col("props.value"), 0.5, nested=True)), (names, "exact", R.Field(F.col("name"), analyzer=keyword)))]
    out = legs[0].unionByName(legs[1]).unionByName(legs[2])
    return out.select("query_id", "asset_id", F.col("fields")[0].alias("field"), F.round("score", 6).alias("score"))


@query(f"WITH {', '.join(_PARTS[:2])}, w AS (SELECT q.p_partkey AS query_id, p.p_partkey AS id, 0.25 AS score FROM part p JOIN part q ON q.p_partkey < 12 AND contains(lower(p.p_name), lower(q.p_name))), u AS (SELECT query_id, id, 3 * score AS score, 'name' AS f FROM nm UNION ALL SELECT query_id, id, score, 'name' FROM w) SELECT query_id, id AS asset_id, round(sum(score), 6) AS score FROM u GROUP BY 1, 2")
def r01_match_and_wildcard(spark, d):
    """Both clauses of one field."""
    part = X.table(spark, d, "part").filter("p_partkey < 12").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text"))
    leg = R.text_leg(X.prop_assets(spark, d), part, {"name": R.Field(F.col("name"), 3.0, 0.25, operator="and")})
    return leg.select("query_id", "asset_id", F.round("score", 6).alias("score"))


_TOKENS = r"regexp_extract_all(lower({}), '[\pL\pN_]+')"
_MATCHED = f"WITH d AS (SELECT doc_id, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS v, {_TOKENS.format('text')} AS t FROM documents), b AS (SELECT item_id, {_TOKENS.format('text')} AS w FROM benchmark), q AS (SELECT item_id AS query_id, {{}} AS w FROM b) SELECT query_id, doc_id AS asset_id FROM d, q WHERE len(w) > 0 AND {{}}"


def _pieces(spark, d, sql):
    """Parts of the benchmark's texts as queries."""
    words = text_queries(spark, d).select("query_id", standard_tokens(F.col("text")).alias("w"))
    return words.select("query_id", F.array_join(F.expr(sql), " ").alias("text"))


@query(_MATCHED.format("list_distinct([w[4], w[2], w[9]])", "len(list_intersect(t, w)) = len(w)"))
def r04_exact_queries(spark, d):
    return R.field_matches(X.assets(spark, d), _pieces(spark, d, "array_distinct(array_compact(array(get(w, 3), get(w, 1), get(w, 8))))"), F.col("text"), "exact")


@query(_MATCHED.format("w[2:5]", "contains(v, ' ' || array_to_string(w, ' ') || ' ')"))
def r04_phrase_queries(spark, d):
    return R.field_matches(X.assets(spark, d), _pieces(spark, d, "slice(w, 2, 4)"), F.col("text"), "phrase")


@query(_MATCHED.format("CASE WHEN item_id % 3 = 0 THEN [left(w[2], 4)] ELSE list_append(w[3:4], left(w[5], 2)) END", "contains(v, ' ' || array_to_string(w, ' '))"))
def r04_prefix_queries(spark, d):
    """Two whole words and the beginning of a third, or the beginning of one."""
    return R.field_matches(X.assets(spark, d), _pieces(spark, d, "if(query_id % 3 = 0, array(left(get(w, 1), 4)), concat(slice(w, 3, 2), array(left(get(w, 4), 2))))"), F.col("text"), "prefix")


_TOP = f"WITH {_bm25()}, {_rank('text_leg', 'top', 25)}, n AS (SELECT query_id, count(*) AS matches FROM text_leg GROUP BY 1) SELECT query_id, asset_id, round(score, 6) AS score, rank, matches FROM top JOIN n USING (query_id)"


@query(_TOP)
def r09_text_top(spark, d):
    """The 25 best of each query by block bounds, and how many assets match it."""
    leg, n = R.text_top(X.assets(spark, d), text_queries(spark, d), {"text": (F.col("text"), 1.0, 0.0)}, 25)
    return leg.join(n, "query_id").select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank", F.col("n").alias("matches"))


@query(_TOP)
def r02_stored_index(spark, d):
    """The same from an index of all words that is written once and then searched."""
    index = R.TextIndex.build(X.assets(spark, d), {"text": R.Field(F.col("text"))})
    leg, n = index.search(text_queries(spark, d), 25)
    return leg.join(n, "query_id").select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank", F.col("n").alias("matches"))


_VLM = [_clause(name, rf"SELECT doc_id AS id, 0 AS e, regexp_extract_all(lower({value}), '[\pL\pN_]+') AS t FROM documents", r"SELECT DISTINCT min(doc_id) AS query_id, unnest(regexp_extract_all(lower(source || ' ' || lang || ' crawl'), '[\pL\pN_]+')) AS term FROM documents GROUP BY source, lang") for name, value in (("cap", "lang"), ("prov", "source || ' crawl'"))]


@query(f"WITH {', '.join(_VLM)}, u AS (SELECT query_id, id, score, 'vlm.caption.value_text' AS f FROM cap UNION ALL SELECT query_id, id, score, 'vlm.provenance.value_text' FROM prov) SELECT query_id, id AS asset_id, round(2 * sum(score), 6) AS score, string_agg(f, ',' ORDER BY f) AS fields FROM u GROUP BY 1, 2")
def r01_generated_metadata(spark, d):
    """The placeholder for generated metadata: a nested field for each plugin in the data."""
    docs = X.table(spark, d, "documents")
    asked = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("query_id")).select("query_id", F.concat_ws(" ", "source", "lang", F.lit("crawl")).alias("text"))
    assets = X.vlm_assets(spark, d)
    leg = R.text_leg(assets, asked, R.metadata_fields(assets, "vlm", R.Field(F.lit(None), 2.0)))
    return leg.select("query_id", "asset_id", F.round("score", 6).alias("score"), F.array_join("fields", ",").alias("fields"))


@query("WITH q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type[2:5]) ELSE p_type[2:5] END AS t FROM part WHERE p_partkey < 12) SELECT query_id, p_partkey AS asset_id, 0.5 AS score FROM part JOIN q ON contains(p_type, t)")
def r01_wildcard_by_case(spark, d):
    """The wildcard clause of a field that tells upper from lower case."""
    part = X.table(spark, d, "part")
    piece = F.substring("p_type", 2, 4)
    asked = part.filter("p_partkey < 12").select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper(piece)).otherwise(piece).alias("text"))
    leg = R.text_leg(part.withColumnRenamed("p_partkey", "asset_id"), asked, {"type": R.Field(F.col("p_type"), 0.0, 0.5, case_sensitive=True)})
    return leg.select("query_id", "asset_id", F.col("score").cast("decimal(2,1)").alias("score"))


@query(r"""WITH vocab AS (SELECT DISTINCT p_type AS w FROM part UNION SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part), v AS (SELECT DISTINCT lower(w) AS word FROM vocab), q AS (SELECT DISTINCT left(word, len(word) - 1) AS term FROM v WHERE len(word) > 3),
 near AS (SELECT term, word, levenshtein(term, word) AS e, row_number() OVER (PARTITION BY term ORDER BY levenshtein(term, word), word) AS r FROM q, v WHERE levenshtein(term, word) BETWEEN 1 AND CASE WHEN len(term) <= 2 THEN 0 WHEN len(term) <= 5 THEN 1 ELSE 2 END)
SELECT term, word, round(1.0 - e / least(len(term), len(word)), 6)::DOUBLE AS boost FROM near WHERE r = 1 UNION ALL SELECT term, term, 1.0 FROM q""")
def r03_fuzzy(spark, d):
    part = X.table(spark, d, "part")
    vocab = part.select(F.col("p_type").alias("w")).union(part.select(F.explode(F.split("p_name", " ")))).select(F.lower("w").alias("term")).distinct()
    terms = vocab.filter(F.length("term") > 3).select(F.lit(1).alias("query_id"), F.expr("left(term, length(term) - 1)").alias("term")).distinct()
    return R.fuzzy_terms(terms, vocab).select("term", "word", F.round("boost", 6).alias("boost"))


@query("SELECT p_partkey, contains(' ' || lower(p_name) || ' ', ' red ') AND contains(' ' || lower(p_name) || ' ', ' widget ') AS exact, contains(' ' || lower(p_name) || ' ', ' red widget ') AS phrase, contains(' ' || lower(p_name) || ' ', ' red wi') AS prefix FROM part")
def r04_match_types(spark, d):
    n = F.col("p_name")
    return X.table(spark, d, "part").select("p_partkey", R.field_match(n, "Widget red", "exact").alias("exact"), R.field_match(n, "red widget", "phrase").alias("phrase"), R.field_match(n, "Red wi", "prefix").alias("prefix"))


@query(f"WITH {_VECTOR}, b AS (SELECT query_id, asset_id, view_offset, list_inner_product(embedding::DOUBLE[], vector::DOUBLE[]) AS s FROM asset_views, vq), {_rank('(SELECT query_id, asset_id, ip AS score FROM ip)', 'top', 50)} SELECT query_id, asset_id, round(score, 6) AS score, rank, (SELECT arg_max(view_offset, (s, -view_offset)) FROM b WHERE b.query_id = top.query_id AND b.asset_id = top.asset_id) AS view_offset FROM top")
def r05_vector_leg(spark, d):
    leg = R.ranked(R.vector_top(X.asset_views(spark, d), vector_queries(spark, d), 50))
    return leg.select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank", "view_offset")


@query(f"WITH {_VECTOR}, {_rank('(SELECT query_id, asset_id, ip AS score FROM ip)', 'top', 20)} SELECT query_id, asset_id, round(score, 6) AS score, rank FROM top")
def r05_vector_batched(spark, d):
    block = [(r.query_id, r.vector) for r in vector_queries(spark, d).collect()]  # 20 stated queries
    leg = R.ranked(R.vector_scores_batched(X.asset_views(spark, d), block, 20)).filter("rank <= 20")
    return leg.select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank")


@query()
def r06_vector_approximate(spark, d):
    """An index over all views, of which each query reads less than a third of the codes."""
    leg = R.ranked(R.vector_candidates(X.asset_views(spark, d), vector_queries(spark, d), 10))
    return leg.select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VECTOR}, {_rank('(SELECT query_id, asset_id, ip AS score FROM ip)', 'top', 15)} SELECT query_id, asset_id, round(score, 6) AS score, rank FROM top")
def r06_stored_index(spark, d):
    """The exact leg from a stored index, by way of lists, codes and every vector that by its code may be among the best."""
    index = R.VectorIndex.build(X.asset_views(spark, d), 64)
    found = R.VectorIndex(spark, index.folder).exact(vector_queries(spark, d), 15)
    return R.ranked(found).select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_bm25()}, {_VECTOR}, ta AS (SELECT query_id, asset_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, hash_value ORDER BY round(score, 9) DESC, asset_id) AS r FROM text_leg JOIN assets USING (asset_id)) WHERE r = 1),
 va AS (SELECT query_id, asset_id, CASE WHEN ip >= 0 THEN 1 + ip ELSE 1 / (1 - ip) END AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, hash_value ORDER BY round(ip, 9) DESC, asset_id) AS r FROM ip JOIN assets USING (asset_id)) WHERE r = 1), {_rank('ta', 't', 100)}, {_rank('va', 'v', 100)},
 l AS (SELECT query_id, asset_id, 0 AS n, rank, 1.0 / (rank + 60) AS part FROM t UNION ALL SELECT query_id, asset_id, 1, rank, 1.0 / (rank + 60) FROM v), g AS (SELECT query_id, asset_id, sum(part) AS rrf_score, min((n, rank)) AS f FROM l GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, f, asset_id) AS rank FROM g),
 c AS (SELECT query_id, max(n) AS corpus_total FROM (SELECT query_id, count(*) AS n FROM ta GROUP BY 1 UNION ALL SELECT query_id, count(*) FROM va GROUP BY 1) GROUP BY 1) SELECT query_id, asset_id, round(rrf_score, 9) AS rrf_score, rank AS position, corpus_total FROM fused JOIN c USING (query_id) WHERE rank <= 32""")
def r18_hybrid_collapsed(spark, d):
    """A hybrid search that shows one asset of each hash."""
    q = text_queries(spark, d).join(vector_queries(spark, d), "query_id", "full_outer")
    assets = X.assets(spark, d)
    views = X.asset_views(spark, d).join(assets.select("asset_id"), "asset_id", "left_semi")
    page = R.hybrid_search(assets, views, q, collapse=True)
    return page.select("query_id", "asset_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("position").cast("long").alias("position"), "corpus_total")


@query(f"WITH {_VECTOR}, {_rank('(SELECT query_id, asset_id, CASE WHEN ip >= 0 THEN 1 + ip ELSE 1 / (1 - ip) END AS score FROM ip)', 'top', 100)} SELECT query_id, asset_id, round(score, 6) AS score, rank FROM top WHERE score >= 1.15")
def r07_engine_score_cutoff(spark, d):
    """R7, R8, R9, W2."""
    leg = R.vector_top(X.asset_views(spark, d), vector_queries(spark, d), R.window_size(0, 10)).withColumn("score", R.engine_score(F.col("score")))
    return R.cutoff(R.leg_window(leg, 0, 10), 1.15).select("query_id", "asset_id", F.round("score", 6).alias("score"), "rank")


_LEGS = f"{_bm25()}, {_VECTOR}, vl AS (SELECT query_id, asset_id, CASE WHEN ip >= 0 THEN 1 + ip ELSE 1 / (1 - ip) END AS score FROM ip), {_rank('text_leg', 't', 100)}, {_rank('vl', 'v', 100)}"
_FUSED = """l AS (SELECT query_id, asset_id, 0 AS n, rank, score, 1.0 / (rank + 60) AS part FROM t UNION ALL SELECT query_id, asset_id, 1, rank, score, 0.5 / (rank + 30) FROM v),
 g AS (SELECT query_id, asset_id, sum(part) AS rrf_score, min((n, rank)) AS f, max(rank) FILTER (n = 0) AS text_rank, max(rank) FILTER (n = 1) AS vector_rank, count(*) AS n_legs FROM l GROUP BY 1, 2),
 fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, f, asset_id) AS rank FROM g)"""


def _fuse(spark, d):
    most, views, asked = R.window_size(0, 10), X.asset_views(spark, d), vector_queries(spark, d)
    t, n = R.text_top(X.assets(spark, d), text_queries(spark, d), {"text": (F.col("text"), 1.0, 0.0)}, most)
    v = R.ranked(R.vector_top(views, asked, most).withColumn("score", R.engine_score(F.col("score"))))
    return R.rrf_fuse([("text", t, 1.0), ("vector", v, 0.5)], k_of={"vector": 30}), [n, R.vector_sizes(views, asked)]


@query(f"WITH {_LEGS}, {_FUSED} SELECT query_id, asset_id, round(rrf_score, 9) AS rrf_score, rank FROM fused")
def r10_rrf_fuse(spark, d):
    """R10, U1 and W1."""
    return _fuse(spark, d)[0].select("query_id", "asset_id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


@query(f"WITH {_bm25()}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, hash_value ORDER BY round(score, 9) DESC, asset_id) AS r FROM text_leg JOIN assets USING (asset_id)) SELECT query_id, asset_id, hash_value FROM h WHERE r = 1")
def r11_collapse(spark, d):
    a = X.assets(spark, d)
    leg = R.text_leg(a, text_queries(spark, d), {"text": (F.col("text"), 1.0, 0.0)})
    return R.collapse_by_hash(leg.join(a.select("asset_id", "hash_value"), "asset_id")).select("query_id", "asset_id", "hash_value")


_DEDUP = f"""WITH RECURSIVE {_VECTOR}, {_rank('(SELECT query_id, asset_id, ip AS score FROM ip)', 'top', 40)}, fv AS (SELECT asset_id, arg_min(embedding, view_offset)::DOUBLE[] AS e FROM asset_views GROUP BY 1),
 h AS (SELECT query_id, asset_id, rank, e FROM top JOIN fv USING (asset_id)), near AS (SELECT a.query_id, a.rank AS early, b.rank AS late FROM h a JOIN h b ON a.query_id = b.query_id AND a.rank < b.rank WHERE 1 - list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) < {{t}}),
 k AS (SELECT query_id, 0 AS rank, []::BIGINT[] AS kept FROM vq UNION ALL SELECT k.query_id, k.rank + 1, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.query_id = k.query_id AND n.late = k.rank + 1 AND list_contains(k.kept, n.early)) THEN k.kept ELSE list_append(k.kept, k.rank + 1) END FROM k WHERE k.rank < 40),
 kept AS (SELECT query_id, unnest(kept) AS rank FROM k WHERE k.rank = 40)"""


def _hits(spark, d):
    return R.ranked(R.vector_top(X.asset_views(spark, d), vector_queries(spark, d), 40)).select("query_id", "asset_id", "rank")


@query(_DEDUP.format(t=0.75) + " SELECT query_id, asset_id, rank FROM top JOIN kept USING (query_id, rank)")
def r12_similarity_dedup(spark, d):
    return R.similarity_dedup(_hits(spark, d), R.first_views(X.asset_views(spark, d)), 0.75)


@query(_DEDUP.format(t=0.7) + " SELECT query_id, asset_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM top JOIN kept USING (query_id, rank)) WHERE r <= 12")
def r13_stream_dedup(spark, d):
    hits = _hits(spark, d).withColumn("base_key", F.concat(F.lit("s3://b/"), F.col("asset_id").cast("string")))
    return R.stream_dedup_filter(hits, R.first_views(X.asset_views(spark, d)), 0.35, 12, ["/thumbs/"]).drop("base_key")


@query(f"WITH {_VECTOR} SELECT query_id, asset_id, round(ip, 6) AS score FROM ip WHERE ip > 0.2")
def r14_score_cutoff(spark, d):
    return R.score_cutoff_stop(R.vector_above(X.asset_views(spark, d), vector_queries(spark, d), 0.2), 0.2).select("query_id", "asset_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_LEGS}, {_FUSED}, n AS (SELECT query_id, count(*) AS total FROM fused GROUP BY 1), c AS (SELECT query_id, max(n) AS corpus_total FROM (SELECT query_id, count(*) AS n FROM text_leg GROUP BY 1 UNION ALL SELECT query_id, count(*) FROM vl GROUP BY 1) GROUP BY 1)
SELECT query_id, asset_id, rank AS position, total, corpus_total FROM fused JOIN n USING (query_id) JOIN c USING (query_id) WHERE rank > 10 AND rank <= 20""")
def r15_paginate(spark, d):
    fused, sizes = _fuse(spark, d)
    return R.paginate(fused, 10, 10, sizes=sizes).select("query_id", "asset_id", F.col("position").cast("long").alias("position"), "total", "corpus_total")


@query(f"WITH {_LEGS}, {_FUSED} SELECT query_id, asset_id, n_legs, text_rank::INT AS text_rank, vector_rank::INT AS vector_rank FROM fused WHERE rank <= 20")
def r16_explain(spark, d):
    e = R.explain_scores(_fuse(spark, d)[0].filter("rank <= 20"))
    return e.select("query_id", "asset_id", F.size("explanations").cast("long").alias("n_legs"), F.col("original_ranks")["text"].alias("text_rank"), F.col("original_ranks")["vector"].alias("vector_rank"))


@query(f"WITH {A} SELECT asset_id, ext, name, size, created_by, modified_by, created_timestamp, modified_timestamp, hash_value, is_deleted, source, lang, base_key, path FROM assets")
def r17_project(spark, d):
    return R.project_source(X.assets(spark, d), return_embeddings=True)


@query(f"""WITH {V}, lq AS (SELECT asset_id AS query_id, arg_min(embedding, view_offset)::DOUBLE[] AS v FROM asset_views WHERE asset_id IN (3, 5, 8) GROUP BY 1),
 s AS (SELECT query_id, asset_id, max(list_inner_product(embedding::DOUBLE[], v)) AS score FROM asset_views, lq WHERE view_offset = 0 AND label IN ('1', '2', '3') GROUP BY 1, 2), {_rank('s', 'top', 15)} SELECT query_id, asset_id, rank FROM top""")
def r19_like_asset(spark, d):
    """Stored views as queries over filtered views of filtered assets."""
    views = X.asset_views(spark, d)
    likes = spark.createDataFrame([(3, 3), (5, 5), (8, 8), (9, -1)], "query_id long, asset_id long")
    q = R.like_asset_queries(likes, views)
    seen = R.filtered_views(views, (F.col("view_offset") == 0) & F.col("label").isin("1", "2", "3"), views.select("asset_id").distinct())
    return R.ranked(R.vector_top(seen, q, 15)).select("query_id", "asset_id", "rank")


_HYBRID = f"""WITH {_bm25("regexp_matches(name, '(?is)^doc_.*$') AND size <= 16777216")}, {_VECTOR}, vl AS (SELECT query_id, asset_id, CASE WHEN ip >= 0 THEN 1 + ip ELSE 1 / (1 - ip) END AS score FROM ip WHERE asset_id IN (SELECT asset_id FROM assets WHERE size <= 16777216)),
 {_rank('text_leg', 't', 100)}, {_rank('vl', 'v', 100)}, l AS (SELECT query_id, asset_id, 0 AS n, rank, 1.0 / (rank + 60) AS part FROM t UNION ALL SELECT query_id, asset_id, 1, rank, 1.0 / (rank + 60) FROM v),
 g AS (SELECT query_id, asset_id, sum(part) AS rrf_score, min((n, rank)) AS f FROM l GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, f, asset_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM g)
SELECT query_id, asset_id, round(rrf_score, 9) AS rrf_score, rank AS position, total FROM fused WHERE rank <= 32"""


@query(_HYBRID)
def r18_hybrid_search(spark, d):
    return flagship(spark, d)


def flagship(spark, d):
    """A filtered search with a text and a vector leg, fused and paged, for a table of queries."""
    from orrery.operators import predicates as P

    q = text_queries(spark, d).join(vector_queries(spark, d), "query_id", "full_outer")
    condition = P.wildcard_include(F.col("name"), "doc_*") & P.size_range(F.col("size"), most="16MB")
    page = R.hybrid_search(X.assets(spark, d), X.asset_views(spark, d), q, condition=condition)
    return page.select("query_id", "asset_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("position").cast("long").alias("position"), "total")


_LIKE = "like_q AS (SELECT asset_id - 1 AS query_id, arg_min(embedding, view_offset)::DOUBLE[] AS v FROM asset_views WHERE asset_id BETWEEN 1 AND 20 GROUP BY 1), like_ip AS (SELECT query_id, asset_id, max(list_inner_product(embedding::DOUBLE[], v)) AS ip FROM asset_views, like_q GROUP BY 1, 2)"


@query(f"""WITH {_bm25()}, {_VECTOR}, {_LIKE}, vl AS (SELECT query_id, asset_id, CASE WHEN ip >= 0 THEN 1 + ip ELSE 1 / (1 - ip) END AS score FROM ip), ll AS (SELECT query_id, asset_id, CASE WHEN ip >= 0 THEN 1 + ip ELSE 1 / (1 - ip) END AS score FROM like_ip),
 {_rank('text_leg', 't', 100)}, {_rank('vl', 'v', 100)}, {_rank('ll', 'a', 100)}, l AS (SELECT query_id, asset_id, 0 AS n, rank, 2.0 / (rank + 60) AS part FROM t UNION ALL SELECT query_id, asset_id, 1, rank, 1.0 / (rank + 60) FROM v UNION ALL SELECT query_id, asset_id, 2, rank, 0.5 / (rank + 60) FROM a),
 g AS (SELECT query_id, asset_id, sum(part) AS rrf_score, min((n, rank)) AS f, count(*) AS n_legs FROM l GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, f, asset_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM g),
 c AS (SELECT query_id, max(n) AS corpus_total FROM (SELECT query_id, count(*) AS n FROM text_leg GROUP BY 1 UNION ALL SELECT query_id, count(*) FROM vl GROUP BY 1 UNION ALL SELECT query_id, count(*) FROM ll GROUP BY 1) GROUP BY 1), images AS (SELECT asset_id, any_value(image) FILTER (view_offset = 0) AS image FROM asset_views GROUP BY 1)
SELECT query_id, asset_id, round(rrf_score, 9) AS rrf_score, rank AS position, total, corpus_total, n_legs::INT AS n_legs, image FROM fused JOIN c USING (query_id) LEFT JOIN images USING (asset_id) WHERE rank <= 25""")
def r18_hybrid_legs(spark, d):
    """A text leg and two vector legs, of stored vectors and of stored assets, each with its weight; explained, and with the images of the hits."""
    from orrery.operators import lookups as L

    views = X.asset_views(spark, d)
    likes = views.filter("asset_id between 1 and 20").select((F.col("asset_id") - 1).alias("query_id"), "asset_id").distinct()
    q = text_queries(spark, d).join(vector_queries(spark, d), "query_id", "full_outer")
    images = lambda page: L.hit_images(page.withColumn("view_offset", F.lit(0)), views)
    page = R.hybrid_search(X.assets(spark, d), views, q, text_weight=2.0, vectors=[("asset", R.like_asset_queries(likes, views), 0.5)], size=25, window=100, explain=True, enrich=[images])
    return page.select("query_id", "asset_id", F.round("rrf_score", 9).alias("rrf_score"), F.col("position").cast("long").alias("position"), "total", "corpus_total", F.size("explanations").alias("n_legs"), "image")


@query(f"""WITH {_LEGS}, {_FUSED}, s AS (SELECT query_id, asset_id, view_offset, list_inner_product(embedding::DOUBLE[], vector::DOUBLE[]) AS s FROM asset_views, vq), b AS (SELECT query_id, asset_id, count(*)::INT AS n, arg_max(view_offset, (s, -view_offset)) AS o, max(s) AS best FROM s WHERE (query_id, asset_id) IN (SELECT query_id, asset_id FROM v) GROUP BY 1, 2)
SELECT query_id, asset_id, CASE WHEN text_rank IS NOT NULL THEN 'text' END AS fields, CASE WHEN n IS NOT NULL THEN least(n, 3)::INT END AS n_views, o AS best_offset, round(best, 6) AS best_score FROM fused LEFT JOIN b USING (query_id, asset_id) WHERE rank <= 20""")
def r16_matched(spark, d):
    """The fields and the views that made a hit."""
    views, asked = X.asset_views(spark, d), vector_queries(spark, d)
    t = R.leg_window(R.text_leg(X.assets(spark, d), text_queries(spark, d), {"text": (F.col("text"), 1.0, 0.0)}), 0, 10)
    v = R.leg_window(R.vector_top(views, asked, 100).withColumn("score", R.engine_score(F.col("score"))), 0, 10)
    fused = R.rrf_fuse([("text", t, 1.0), ("vector", R.with_views(v, views, asked), 0.5)], k_of={"vector": 30})
    e = R.explain_scores(fused.filter("rank <= 20"))
    of = lambda leg: F.get(F.filter("explanations", lambda x: x["leg"] == leg), 0)
    e = e.select("query_id", "asset_id", of("text")["fields"].alias("f"), of("vector")["views"].alias("v"))
    return e.select("query_id", "asset_id", F.array_join("f", ",").alias("fields"), F.when(F.col("v").isNotNull(), F.size("v")).alias("n_views"), F.get("v", 0)["offset"].alias("best_offset"), F.round(F.get("v", 0)["score"], 6).alias("best_score"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\pL\pN_]+'))::INT AS n FROM documents")
def r02_field_lengths(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.size(standard_tokens(F.col("text"))).alias("n"))
