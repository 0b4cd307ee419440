"""Ranked retrieval for tables of queries: text and vector legs, windows, weighted reciprocal rank fusion, deduplication, pages.

A leg is a DataFrame (query_id, asset_id, score, rank). Query tables are small next to the corpus, but no
plan depends on that: legs are joins on terms or on buckets, and top-k is a grouped window, of which every
task passes on k rows per query at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.exprs import cosine_distance, dot, standard_tokens
from orrery.sources.tables import spread, written

from .vectorindex import SHARE, VectorIndex
from .textindex import K1, MOST_TERMS, B, Field, TextIndex, occurrences, search, segments, sizes, top  # noqa: F401

RANK_CONSTANT = 60
MOST_WINDOW, LEAST_WINDOW = 10_000, 100


#: Rows of a table of requests that are broadcast together.
BLOCK_QUERIES = 4096


def query_blocks(queries: DataFrame, most: int = BLOCK_QUERIES) -> list[DataFrame]:
    """A table of requests in blocks of a checked size, each marked for broadcast; more requests make more blocks."""
    n = -(-queries.count() // most) or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return [F.broadcast(queries if n == 1 else queries.filter(block == k)) for k in range(n)]


# The text leg


def small(df: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """df, written once and marked for broadcast if it has no more rows than that."""
    df = written(df, "terms")
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def field_tokens(docs: DataFrame, field: Field, id_col: str = "asset_id") -> DataFrame:
    """(id, field, element, tokens, length): the texts of a field that have tokens, cut by its analyzer; a document's rows follow each other."""
    return occurrences(docs, [field], id_col)


def query_terms(queries: DataFrame, text: str = "text", analyzer: Callable[[Column], Column] = standard_tokens) -> DataFrame:
    """(query_id, term)."""
    return queries.select("query_id", F.explode(F.array_distinct(analyzer(F.col(text)))).alias("term"))


def bm25(tokens: DataFrame, terms: DataFrame, *, operator: str = "or", id_col: str = "asset_id", k1: float = K1, b: float = B) -> DataFrame:
    """R2: (query_id, id, score), summed over the elements of a document.

    tokens as of field_tokens(), terms(query_id, term, word, boost): words that stand for each term. How many texts
    there are and how long they are is taken over the whole corpus; only occurrences of asked words are counted,
    once. Scores come from the task that holds a document, so hits aren't shuffled.
    """
    terms = written(terms.select("query_id", F.lit(0).alias("field"), "term", "word", F.col("boost").cast("double").alias("weight")), "asked")
    stored = written(segments(tokens, terms.select("word"), id_col), "postings")
    return search(stored, terms, [(operator, False)], id_col=id_col, k1=k1, b=b).filter(F.col(id_col).isNotNull()).select("query_id", id_col, "score")


def fuzzy_terms(terms: DataFrame, vocabulary: DataFrame, expansions: int = 1) -> DataFrame:
    """Each term and its nearest words of the vocabulary within AUTO fuzziness (0 up to 2 letters, 1 up to 5, then 2); at most `expansions` others.

    Words within an edit distance share their length give or take it, and one of its three thirds (or of a
    term of up to 5 letters, one half) at a place shifted by no more than it; that is what is joined on.
    """
    n = F.length("term")
    allowed = F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)
    t = terms.select("query_id", "term").distinct().withColumn("allowed", allowed).filter("allowed > 0")
    pieces = F.when(F.col("allowed") == 1, 2).otherwise(3)

    def cut(c: Column, n: Column) -> Column:
        at = lambda i: F.floor(F.length(c) * i / n).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), at(i).alias("at"), F.substring(c, at(i) + 1, at(i + 1) - at(i)).alias("piece")))

    a = t.withColumn("n", pieces).withColumn("p", F.explode(cut(F.col("term"), F.col("n"))))
    a = a.withColumn("shift", F.explode(F.sequence(-F.col("allowed"), F.col("allowed")))).select("query_id", "term", "allowed", F.col("p.piece").alias("piece"), (F.col("p.at") + F.col("shift")).alias("at")).filter("at >= 0 and piece <> ''")
    sizes = a.select(F.length("piece").alias("size")).distinct()
    v = vocabulary.select(F.col("term").alias("word")).distinct().withColumn("len", F.length("word"))
    # every piece of a wanted size of every word
    s = v.join(F.broadcast(sizes), F.col("size") <= F.col("len")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size")))).select("word", "at", F.expr("substring(word, at + 1, size)").alias("piece"))
    near = a.join(s, ["piece", "at"]).select("query_id", "term", "allowed", "word").distinct()
    near = near.withColumn("edits", F.levenshtein("term", "word")).filter("edits between 1 and allowed")
    w = Window.partitionBy("query_id", "term").orderBy("edits", "word")
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= expansions)
    boost = 1.0 - F.col("edits") / F.least(F.length("term"), F.length("word"))
    exact = terms.select("query_id", "term").distinct().select("query_id", "term", F.col("term").alias("word"), F.lit(1.0).alias("boost"))
    return exact.unionByName(near.select("query_id", "term", "word", boost.alias("boost")))


def field_match(value: Column, query: str, kind: str) -> Column:
    """Exact (every token), phrase (tokens in a row), prefix (phrase whose last token may go on)."""
    tokens, wanted = standard_tokens(value), standard_tokens(F.lit(query))
    if kind == "exact":
        return F.forall(wanted, lambda w: F.array_contains(tokens, w))
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    phrase = F.concat(F.lit(" "), F.array_join(wanted, " "))
    if kind == "phrase":
        return F.contains(joined, F.concat(phrase, F.lit(" ")))
    if kind == "prefix":
        return F.contains(joined, phrase)
    raise ValueError(kind)


def field_matches(docs: DataFrame, queries: DataFrame, value: Column, kind: str, id_col: str = "asset_id") -> DataFrame:
    """R4 for a table of queries(query_id, text): (query_id, id) of what field_match() holds for, in the kinds it knows.

    An equi-join on the longest whole token of a query, at its places in a document, then a comparison of the tokens
    around that place: no query meets a text that lacks this token. A prefix of one token joins on its first three
    letters, or all it has if fewer. Queries without tokens match nothing; no text has a token that is null.
    """
    if kind not in ("exact", "phrase", "prefix"):
        raise ValueError(kind)
    asked = queries.select("query_id", standard_tokens(F.col("text")).alias("_w")).filter(F.size("_w") > 0).withColumn("_n", F.size("_w"))
    whole = F.slice("_w", F.lit(1), F.col("_n") - 1) if kind == "prefix" else F.col("_w")
    anchor = F.array_max(F.transform(whole, lambda t, i: F.struct(F.length(t).alias("length"), i.alias("at"), t.alias("term"))))
    asked = asked.withColumn("_a", anchor).select("query_id", "_w", "_n", F.col("_a.at").alias("_at"), F.col("_a.term").alias("_term"))
    texts = spread(docs.select(id_col, value.alias("_v"))).select(id_col, standard_tokens(F.col("_v")).alias("_t"))
    known = small(asked.filter("_term is not null"))
    if kind == "exact":
        met = texts.select(id_col, "_t", F.explode(F.array_distinct("_t")).alias("_term")).join(known, "_term")
        return met.filter(F.size(F.array_except("_w", "_t")) == 0).select("query_id", id_col)
    met = texts.select(id_col, "_t", F.posexplode("_t").alias("_p", "_term")).join(known, "_term").withColumn("_p", F.col("_p") - F.col("_at"))
    met = met.filter((F.col("_p") >= 0) & (F.col("_p") + F.col("_n") <= F.size("_t")))
    around = lambda n: F.slice("_t", F.col("_p") + 1, n)
    if kind == "phrase":
        return met.filter(around(F.col("_n")) == F.col("_w")).select("query_id", id_col).distinct()
    begins = F.startswith(F.get("_t", F.col("_p") + F.col("_n") - 1), F.element_at("_w", -1))
    found = met.filter((around(F.col("_n") - 1) == F.slice("_w", F.lit(1), F.col("_n") - 1)) & begins).select("query_id", id_col)
    alone = small(asked.filter("_term is null").select("query_id", F.col("_w")[0].alias("_q")).withColumn("_g", F.substring("_q", 1, 3)))
    sizes = [r.n for r in alone.select(F.length("_g").alias("n")).distinct().collect()]  # 1, 2, 3
    if sizes:
        each = texts.select(id_col, F.explode(F.array_distinct("_t")).alias("_term")).withColumn("_g", F.explode(F.array_distinct(F.array(*(F.substring("_term", 1, n) for n in sizes)))))
        found = found.unionByName(each.join(alone, "_g").filter(F.startswith("_term", "_q")).select("query_id", id_col))
    return found.distinct()


def contained(values: DataFrame, asked: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """(query_id, id) of values(id, _v) that hold _q of asked(query_id, _q): an equi-join on the first three letters of a query, or all it has if fewer, then a check."""
    asked = small(asked.withColumn("gram", F.substring("_q", 1, 3)))
    sizes = [r.n for r in asked.select(F.length("gram").alias("n")).distinct().collect()]  # 1, 2, 3
    if not sizes:
        return values.select(F.lit(None).cast("long").alias("query_id"), id_col).limit(0)
    grams = [F.regexp_extract_all("_v", F.lit(f"(?s)(?=(.{{{n}}}))")) for n in sizes]  # every piece of n letters, in one pass
    each = F.array_distinct(F.flatten(F.array(*grams)))
    met = values.filter("_v <> ''").select(id_col, "_v", F.explode(each).alias("gram")).join(asked, "gram")
    return met.filter(F.contains("_v", "_q")).select("query_id", id_col)


def _matches(docs: DataFrame, queries: DataFrame, fields: dict[str, Field], k: int | None, id_col: str, key: Column | None = None) -> DataFrame:
    """The match clauses of all fields: rows of textindex.search(). key: documents with the same one collapse."""
    matched = {n: f for n, f in fields.items() if f.match}
    found, asked = occurrences(docs, list(matched.values()), id_col, key), []
    for n, f in enumerate(matched.values()):
        terms = query_terms(queries, analyzer=f.analyzer)
        if f.fuzzy:
            terms = fuzzy_terms(terms, found.filter(F.col("field") == n).select(F.explode("tokens").alias("term")).distinct(), f.fuzzy)
        else:
            terms = terms.select("query_id", "term", F.col("term").alias("word"), F.lit(1.0).alias("boost"))
        asked.append(terms.select("query_id", F.lit(n).alias("field"), "term", "word", (F.col("boost") * float(f.match)).alias("weight")))
    asked = written(reduce(DataFrame.unionByName, asked), "asked")
    stored = written(segments(found, asked.select("word"), id_col), "postings")
    return search(stored, asked, [(f.operator, f.nested) for f in matched.values()], k, id_col=id_col, keyed=key is not None)


def _named(fields: dict[str, Field]) -> Column:
    """Names of the fields whose bits are set, in order of their names. Match clauses take the lower bits."""
    order = [*(n for n, f in fields.items() if f.match), *(n for n, f in fields.items() if not f.match)]
    return F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(1 << order.index(n)) != 0, n) for n in sorted(fields))))


def _fields(fields: dict[str, Field | tuple[Column, float, float]]) -> dict[str, Field]:
    return {n: f if isinstance(f, Field) else Field(*f) for n, f in fields.items()}


def text_leg(docs: DataFrame, queries: DataFrame, fields: dict[str, Field | tuple[Column, float, float]], id_col: str = "asset_id") -> DataFrame:
    """(query_id, id, score, fields): the weighted clauses of all fields summed, and the names of the fields that matched. A tuple is a Field's text, match and wildcard.

    A match clause scores by BM25 over the field's own texts, with the field's operator, analyzer and fuzzy words.
    The wildcard clause (*query* anywhere in the field, in any case unless the field says otherwise) compares whole
    values. Queries without tokens have no match clause, and without any clause no hits.
    """
    fields = _fields(fields)
    order = [*(n for n, f in fields.items() if f.match), *(n for n, f in fields.items() if not f.match)]
    parts = []
    if any(f.match for f in fields.values()):
        parts.append(_matches(docs, queries, fields, None, id_col).filter(F.col(id_col).isNotNull()).select("query_id", id_col, "score", "bits"))
    for name, f in fields.items():
        if f.wildcard:
            case = (lambda c: F.col(c)) if f.case_sensitive else F.lower
            asked = queries.filter(F.trim("text") != "").select("query_id", case("text").alias("_q"))
            values = docs.select(id_col, F.explode(f.text).alias("_v")) if f.nested else docs.select(id_col, f.text.alias("_v"))
            held = contained(values.select(id_col, case("_v").alias("_v")), asked, id_col)
            held = held.distinct() if f.nested else held
            parts.append(held.select("query_id", id_col, F.lit(float(f.wildcard)).alias("score"), F.lit(1 << order.index(name)).cast("long").alias("bits")))
    leg = reduce(DataFrame.unionByName, parts)
    if any(f.wildcard for f in fields.values()):
        leg = leg.groupBy("query_id", id_col).agg(F.sum("score").alias("score"), F.bit_or("bits").alias("bits"))
    return leg.select("query_id", id_col, "score", _named(fields).alias("fields"))


def text_top(docs: DataFrame, queries: DataFrame, fields: dict[str, Field | tuple[Column, float, float]], k: int, id_col: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """The k best of text_leg() with their rank, and how many documents each query matches (query_id, n). Of match clauses no task passes on more than k hits of a query; wildcard clauses need all hits."""
    fields = _fields(fields)
    if any(f.wildcard for f in fields.values()):
        leg = written(text_leg(docs, queries, fields, id_col), "text-leg")
        return ranked(leg, id_col).filter(F.col("rank") <= k), leg.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = written(_matches(docs, queries, fields, k, id_col), "hits")
    return top(hits, k, id_col).select("query_id", id_col, "score", _named(fields).alias("fields"), "rank"), sizes(hits, id_col)


def text_collapsed(docs: DataFrame, queries: DataFrame, fields: dict[str, Field | tuple[Column, float, float]], k: int, id_col: str = "asset_id") -> tuple[DataFrame, DataFrame]:
    """text_top() of the best hit of each hash_value of docs, and how many hashes each query matches (query_id, n); hits without a hash all stay.

    Of match clauses a task passes on the best of its k best hashes, as documents are dealt by hash; wildcard clauses need all hits.
    """
    fields = _fields(fields)
    if any(f.wildcard for f in fields.values()):
        leg = written(collapse_by_hash(text_leg(docs, queries, fields, id_col).join(docs.select(id_col, "hash_value"), id_col), id_col).drop("hash_value"), "text-leg")
        return ranked(leg, id_col).filter(F.col("rank") <= k), leg.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = written(_matches(docs, queries, fields, k, id_col, _hash_key(id_col)), "hits")
    return top(hits, k, id_col).select("query_id", id_col, "score", _named(fields).alias("fields"), "rank"), sizes(hits, id_col)


def metadata_fields(docs: DataFrame, column: str, field: Field) -> dict[str, Field]:
    """The placeholder for generated metadata as one nested field per plugin that the data know, each with the placeholder's settings, over the plugin's value texts; none if there are none.

    column: map from plugin to entries with value_text (a list of texts). Names of plugins are few and told apart by
    the data, not by a list; labels of entries are no text to search.
    """
    plugins = [r.p for r in docs.select(F.explode(F.map_keys(column)).alias("p")).distinct().orderBy("p").collect()]  # a row per plugin
    return {f"{column}.{p}.value_text": replace(field, text=F.flatten(F.transform(F.col(column)[p], lambda e: e["value_text"])), nested=True) for p in plugins}


# Vector legs, scores, windows


def vector_scores(views: DataFrame, queries: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """R5, exact: (query_id, id, score, view_offset) of every asset and query, best view per asset: as many rows as there are pairs. For the best of each query, or all over a score, see vector_top() and vector_above()."""
    return _vector_parts(views, queries, None, id_col)


#: Queries of which a batch's scores are held at a time.
HELD_QUERIES = 256


def vector_scores_batched(views: DataFrame, queries: list[tuple[int, list[float]]], k: int | None, id_col: str = "asset_id", *, least: float | None = None, group: str | None = None) -> DataFrame:
    """R5 for many queries at once: matrix products over Arrow batches; each batch passes on the best view of its k best assets per query (all without k), ties to the smaller id as in ranked().

    least: only scores over it. group: a column of views by which only the best asset of each value counts; assets
    without one count each for itself. Views of another width than the queries' take no part.
    """
    ids = np.array([q for q, _ in queries])
    matrix = np.array([v for _, v in queries], np.float64)
    shared = views.sparkSession.sparkContext.broadcast((ids, matrix))  # one block of queries
    columns = [id_col, "view_offset", "embedding"] + ([group] if group else [])

    def one_of_each(key: np.ndarray, order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort([*order[::-1], key])
        return by, np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])

    def run(batches):
        ids, matrix = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            assets, offsets = pdf[id_col].to_numpy(), pdf["view_offset"].to_numpy()
            by, first = one_of_each(assets, [offsets])  # an asset's views side by side
            x, assets, offsets = x[by], assets[by], offsets[by]
            owner = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(assets)]))
            names = pdf[group].to_numpy()[by][first] if group else None
            for a in range(0, len(ids), HELD_QUERIES):
                s = x @ matrix[a : a + HELD_QUERIES].T
                s[np.isnan(s)] = -np.inf  # vectors without a score come last
                best = np.maximum.reduceat(s, first, axis=0)
                for n in range(s.shape[1]):
                    score = best[:, n]
                    on = np.arange(len(score)) if least is None else np.flatnonzero(score > least)
                    if k is not None and len(on) > k and not group:
                        near = np.round(score[on], 9)
                        on = on[near >= np.partition(near, len(on) - k)[len(on) - k]]  # the k best and what ties with the last
                    on = on[np.lexsort((assets[first][on], -np.round(score[on], 9)))]
                    if group:
                        seen, keep = set(), []
                        for i in on.tolist():
                            if names[i] is None or names[i] not in seen:
                                seen.add(names[i])
                                keep.append(i)
                        on = np.array(keep, np.int64)
                    on = on[:k]
                    hit = np.flatnonzero(s[:, n] == score[owner])  # of an asset's views the first that is best
                    view = hit[np.searchsorted(owner[hit], on)] if len(on) else on
                    out = {"query_id": ids[a + n], id_col: assets[view], "view_offset": offsets[view], "s": score[on]}
                    yield pd.DataFrame(out if not group else out | {group: names[on]})

    told = f", {group} string" if group else ""
    rows = views.filter(F.size("embedding") == matrix.shape[1]).select(*columns)
    scored = rows.mapInPandas(run, f"query_id long, {id_col} long, view_offset int, s double{told}")
    best = F.max(F.struct(F.col("s"), (-F.col("view_offset")).alias("o"))).alias("b")
    more = [F.first(group).alias(group)] if group else []
    return scored.groupBy("query_id", id_col).agg(best, *more).select("query_id", id_col, F.col("b.s").alias("score"), (-F.col("b.o")).alias("view_offset"), *([group] if group else []))


def _vector_parts(views: DataFrame, queries: DataFrame, k: int | None, id_col: str, **options) -> DataFrame:
    """vector_scores_batched() of all queries, a block of BLOCK_QUERIES of one width at a time."""
    queries = written(queries.filter("vector is not null").select("query_id", "vector"), "queries")
    n, parts = -(-queries.count() // BLOCK_QUERIES) or 1, []
    for block in range(n):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).collect()
        for width in sorted({len(r.vector) for r in rows}):
            parts.append(vector_scores_batched(views, [(r.query_id, r.vector) for r in rows if len(r.vector) == width], k, id_col, **options))
    if not parts:
        told = f", {options['group']} string" if options.get("group") else ""
        return views.sparkSession.createDataFrame([], f"query_id long, {id_col} long, score double, view_offset int{told}")
    return reduce(DataFrame.unionByName, parts)


def vector_top(views: DataFrame, queries: DataFrame, k: int, id_col: str = "asset_id") -> DataFrame:
    """R5, exact: each query's k best assets (query_id, id, score, view_offset), of which every task passes on k of a batch and no more. queries(query_id, vector) are held a block of BLOCK_QUERIES at a time."""
    return ranked(_vector_parts(views, queries, k, id_col), id_col).filter(F.col("rank") <= k).drop("rank")


def vector_above(views: DataFrame, queries: DataFrame, least: float, id_col: str = "asset_id") -> DataFrame:
    """R14, exact: every asset that scores over `least` (query_id, id, score, view_offset); nothing else leaves a task."""
    return _vector_parts(views, queries, None, id_col, least=least)


def vector_collapsed(views: DataFrame, queries: DataFrame, hashes: DataFrame, k: int, id_col: str = "asset_id") -> DataFrame:
    """The k best assets of each query of which no two share a hash (query_id, id, score, view_offset). hashes(id, hash_value); a task passes on the best of its k best hashes."""
    known = views.join(hashes.select(id_col, "hash_value"), id_col)
    best = _vector_parts(known, queries, k, id_col, group="hash_value")
    return ranked(collapse_by_hash(best, id_col), id_col).filter(F.col("rank") <= k).drop("rank", "hash_value")


def vector_sizes(views: DataFrame, queries: DataFrame, id_col: str = "asset_id", group: Column | None = None) -> DataFrame:
    """(query_id, n): assets, or groups of them, that a query's vector leg holds, told by the width of vectors."""
    of_width = views.groupBy(F.size("embedding").alias("width")).agg(F.countDistinct(F.col(id_col) if group is None else group).alias("n"))
    return queries.filter("vector is not null").withColumn("width", F.size("vector")).join(F.broadcast(of_width), "width").select("query_id", "n")  # a row per width of vectors


def vector_candidates(views: DataFrame, queries: DataFrame, k: int = 100, *, share: float = SHARE, id_col: str = "asset_id") -> DataFrame:
    """R6, approximate: each query's k best of a VectorIndex that is built of the views for it, one for each width of the queries; vectors of different widths never meet. To search an index more than once, build it and keep it."""
    widths = [r.n for r in queries.select(F.size("vector").alias("n")).distinct().filter("n > 0").collect()]
    built = [VectorIndex.build(views, n, id_col=id_col) for n in widths]
    parts = [index.search(queries, k, share=share) for index in built if index]
    return reduce(DataFrame.unionByName, parts) if parts else views.sparkSession.createDataFrame([], f"query_id long, {id_col} long, score double, view_offset int")


def engine_score(ip: Column) -> Column:
    """R7."""
    return F.when(ip >= 0, 1 + ip).otherwise(1 / (1 - ip))


def ranked(leg: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Position by score in each query, ties to the smaller id."""
    return leg.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), id_col)))


def window_size(start: int, size: int, window: int | None = None) -> int:
    """R9."""
    return min(window or max(LEAST_WINDOW, 2 * (start + size)), MOST_WINDOW)


def leg_window(leg: DataFrame, start: int, size: int, window: int | None = None, id_col: str = "asset_id") -> DataFrame:
    """The best of each query, ranked."""
    return ranked(leg, id_col).filter(F.col("rank") <= window_size(start, size, window))


def cutoff(leg: DataFrame, least: float) -> DataFrame:
    """Survivors keep their ranks."""
    return leg.filter(F.col("score") >= least)


def _hash_key(id_col: str) -> Column:
    """What collapses hits: their hash, or if they have none themselves."""
    return F.coalesce(F.col("hash_value").cast("string"), F.concat(F.lit("#"), F.col(id_col).cast("string")))


def collapse_by_hash(leg: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """The best hit of each hash; hits without a hash all stay."""
    w = Window.partitionBy("query_id", _hash_key(id_col)).orderBy(F.desc(F.round("score", 9)), id_col)
    return leg.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


VIEWS = "array<struct<score: double, offset: int, image: string, label: string>>"


def with_views(leg: DataFrame, views: DataFrame, queries: DataFrame, most: int = 3, id_col: str = "asset_id") -> DataFrame:
    """The leg's hits with the `most` best views of each asset for the query: score, offset, image, label. leg: a window of hits."""
    met = leg.select("query_id", id_col).join(views, id_col).join(small(queries.select("query_id", "vector")), "query_id").filter(F.size("embedding") == F.size("vector"))
    scored = met.select("query_id", id_col, F.struct((-dot(F.col("embedding"), F.col("vector"))).alias("s"), F.col("view_offset").alias("offset"), "image", "label").alias("view"))
    w = Window.partitionBy("query_id", id_col).orderBy("view")
    scored = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    best = F.array_sort(F.collect_list("view"))
    told = F.transform(best, lambda v: F.struct((-v["s"]).alias("score"), v["offset"].alias("offset"), v["image"].alias("image"), v["label"].alias("label")))
    return leg.join(scored.groupBy("query_id", id_col).agg(told.alias("views")), ["query_id", id_col], "left")


def rrf_fuse(legs: list[tuple[str, DataFrame, float]], k: int = RANK_CONSTANT, k_of: dict[str, int] | None = None, id_col: str = "asset_id") -> DataFrame:
    """Sum of weight / (rank + k) over legs (name, leg, weight); ties go to the first leg, then the rank in it. legs lists each leg's rank, score and part, with the fields and views that matched if the leg tells."""
    parts = []
    for n, (name, leg, weight) in enumerate(legs):
        kk = (k_of or {}).get(name, k)
        told = [(F.col(c) if c in leg.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("fields", "array<string>"), ("views", VIEWS))]
        parts.append(leg.select("query_id", id_col, F.lit(n).alias("n"), F.lit(name).alias("leg"), F.col("rank").cast("int").alias("leg_rank"), F.col("score").cast("double").alias("leg_score"), (F.lit(float(weight)) / (F.col("rank") + kk)).alias("part"), F.lit(kk).alias("k"), *told))
    met = reduce(DataFrame.unionByName, parts)
    fused = met.groupBy("query_id", id_col).agg(F.sum("part").alias("rrf_score"), F.min(F.struct("n", "leg_rank")).alias("first"), F.array_sort(F.collect_list(F.struct("n", "leg", "leg_rank", "leg_score", "part", "k", "fields", "views"))).alias("legs"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "first.n", "first.leg_rank", id_col)
    return fused.withColumn("rank", F.row_number().over(w)).select("query_id", id_col, "rrf_score", "rank", "legs")


#: Hits of a query that one task decides among themselves, and such that it compares with those kept before.
DEDUP_BLOCK, DEDUP_PART = 1000, 20_000


def _directions(col: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors by width: places of the rows that have one, and the vectors. Null and zero vectors have none."""
    col = col.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    out = []
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        x = pc.list_flatten(col.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
        n = np.sqrt((x * x).sum(1))
        out.append((at[n > 0], x[n > 0] / n[n > 0, None]))
    return out


def _first_kept(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        keep = np.ones(len(rows), bool)
        for at, u in _directions(rows.column("vector")):
            near = 1 - u @ u.T < threshold
            alive = np.ones(len(at), bool)
            for i in range(len(at)):
                if alive[i]:
                    alive[i + 1 :] &= ~near[i, i + 1 :]
            keep[at] = alive
        return rows.filter(pa.array(keep))

    return run


def _not_near(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, kept: pa.Table) -> pa.Table:
        keep = np.ones(len(rows), bool)
        if len(kept):
            known = {u.shape[1]: u for _, u in _directions(kept.column("vector"))}
            for at, u in _directions(rows.column("vector")):
                if u.shape[1] in known:
                    for a in range(0, len(at), 4096):
                        keep[at[a : a + 4096]] = ~(1 - u[a : a + 4096] @ known[u.shape[1]].T < threshold).any(1)
        return rows.filter(pa.array(keep))

    return run


def similarity_dedup(hits: DataFrame, vectors: DataFrame, threshold: float, id_col: str = "asset_id", *, block: int = DEDUP_BLOCK, part: int = DEDUP_PART) -> DataFrame:
    """Greedy in rank order: a hit nearer than the threshold to a kept hit goes. vectors(id, vector): first views. Hits without a vector stay; a zero vector is 2 from all, and so are vectors of another width.

    In rounds, all queries together: a task decides the next `block` hits of a query, which nothing undecided comes
    before; then all later hits of it, dealt over tasks, are compared with those that were kept. Every hit meets each
    kept hit at most once, no pairs are passed on, and no task holds more than a block and a part. A threshold of 0
    keeps all.
    """
    if threshold <= 0:
        return hits
    columns = ["query_id", id_col, "rank", "vector"]
    schema = hits.select("query_id", id_col, "rank").join(vectors.select(id_col, F.col("vector").cast("array<double>").alias("vector")), id_col).select(*columns).schema
    left = written(hits.select("query_id", id_col, "rank").join(vectors.select(id_col, F.col("vector").cast("array<double>").alias("vector")), id_col, "left").select(*columns), "undecided")
    kept = []
    while True:
        placed = left.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        most = placed.agg(F.max("_n")).first()[0] or 0
        first = placed.filter(F.col("_n") <= block).select(*columns).groupBy("query_id").applyInArrow(_first_kept(threshold), schema)
        if most <= block:
            kept.append(first)
            break
        first = written(first, "kept")
        kept.append(first)
        parts = -(-most // part)
        rest = placed.filter(F.col("_n") > block).select(*columns, F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("_part"))
        seen = first.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        compared = rest.groupBy("query_id", "_part").cogroup(seen.groupBy("query_id", "_part")).applyInArrow(_not_near(threshold), rest.schema)
        left = written(compared.select(*columns), "undecided")
    keys = reduce(DataFrame.unionByName, kept).select("query_id", id_col)
    return hits.join(keys, ["query_id", id_col], "left_semi").select(*hits.columns)


def stream_dedup_filter(hits: DataFrame, vectors: DataFrame, threshold: float, most: int, excluded: list[str] = (), id_col: str = "asset_id", path: str = "base_key") -> DataFrame:
    """Excluded substrings and repeated paths go, then near items by half the cosine distance; at most `most` per query."""
    good = hits.filter(~reduce(lambda a, b: a | b, [F.col(path).contains(x) for x in excluded], F.lit(False)))
    w = Window.partitionBy("query_id", path).orderBy("rank")
    good = good.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    kept = similarity_dedup(good, vectors, 2 * threshold, id_col)
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("_r") <= most).drop("_r")


def score_cutoff_stop(leg: DataFrame, least: float) -> DataFrame:
    """Strictly over the cutoff; of sorted scores that is what comes before the first failure."""
    return leg.filter(F.col("score") > least)


def paginate(fused: DataFrame, start: int, size: int, legs: list[DataFrame] = (), sizes: list[DataFrame] = ()) -> DataFrame:
    """One page of each query, with total (hits fused) and corpus_total (the largest leg). sizes(query_id, n): hits of legs that are counted already."""
    w = Window.partitionBy("query_id")
    page = fused.withColumn("position", F.row_number().over(w.orderBy("rank"))).withColumn("total", F.count("*").over(w))
    out = page.filter((F.col("position") > start) & (F.col("position") <= start + size))
    counts = [*sizes, *(x.groupBy("query_id").agg(F.count("*").alias("n")) for x in legs)]
    if counts:
        out = out.join(reduce(DataFrame.unionByName, counts).groupBy("query_id").agg(F.max("n").alias("corpus_total")), "query_id", "left")
    return out


def explain_scores(fused: DataFrame) -> DataFrame:
    """Explanations (leg, score, rank, contribution, k, matched fields, matched views) and original_ranks (by leg name, the last leg of a name)."""
    each = F.transform("legs", lambda x: F.struct(x["leg"].alias("leg"), x["leg_score"].alias("score"), x["leg_rank"].alias("rank"), x["part"].alias("rrf"), x["k"].alias("k"), x["fields"].alias("fields"), x["views"].alias("views")))
    names = F.array_distinct(F.col("legs.leg"))
    ranks = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter("legs", lambda x: x["leg"] == n), -1)["leg_rank"]))
    return fused.withColumn("explanations", each).withColumn("original_ranks", ranks)


HEAVY = {"return_embeddings": ["embedding", "views"], "return_images": ["image", "image_payload"], "return_metadata": ["props", "tags", "vlm", "text"]}


def project_source(hits: DataFrame, **flags: bool) -> DataFrame:
    """Heavy columns stay only if their flag is set; Catalyst prunes them down to the scan."""
    return hits.drop(*(c for flag, columns in HEAVY.items() if not flags.get(flag, False) for c in columns))


def like_asset_queries(likes: DataFrame, views: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """likes(query_id, id) to (query_id, vector): each asset's first view; assets without one give no query."""
    first = views.groupBy(id_col).agg(F.min_by("embedding", "view_offset").alias("vector"))
    return likes.join(first, id_col).select("query_id", "vector")


def filtered_views(views: DataFrame, view_filter: Column | None = None, assets: DataFrame | None = None, id_col: str = "asset_id") -> DataFrame:
    """The view filter decides which views may score, the assets (already filtered) which assets."""
    out = views if view_filter is None else views.filter(view_filter)
    return out if assets is None else out.join(assets.select(id_col), id_col, "left_semi")


def first_views(views: DataFrame, id_col: str = "asset_id") -> DataFrame:
    return views.groupBy(id_col).agg(F.min_by("embedding", "view_offset").alias("vector"))


def hybrid_search(assets: DataFrame, views: DataFrame, queries: DataFrame, *, condition: Column | None = None, fields: dict[str, Field | tuple[Column, float, float]] | None = None, text_weight: float = 1.0, vector_weight: float = 1.0, vectors: list[tuple[str, DataFrame, float]] = (), k: int = RANK_CONSTANT, cutoff_threshold: float | None = None, dedup: float = 0.0, start: int = 0, size: int = 32, window: int | None = None, collapse: bool = False, access: DataFrame | None = None, explain: bool = False, enrich: list[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """Filters, legs, cutoff, fusion, deduplication, access, page, enrichment. queries(query_id, text, vector); a leg without queries is left out.

    vectors: more vector legs (name, queries(query_id, vector), weight), as of images or stored assets (R19).
    Filters come before every leg and access before the page, so pages are full. Of a text leg only the best hits are written; a
    vector leg passes on its window alone, and its size is counted apart. explain: with matched fields and views.
    enrich: functions that add columns to the page (J4 to J6), which has base_key.
    """
    rows = assets if condition is None else assets.filter(condition)
    if access is not None:
        rows = rows.join(access, "base_key", "left_semi")
    most, legs, sizes = window_size(start, size, window), [], []

    if text_weight:
        asked, fields = queries.filter("text is not null"), fields or {"text": (F.col("text"), 1.0, 0.0)}
        leg, size_of = (text_collapsed if collapse else text_top)(rows, asked, fields, most)
        legs.append(("text", leg, text_weight))
        sizes.append(size_of)
    hashes = written(rows.select("asset_id", "hash_value"), "hashes") if collapse else None
    seen = written(filtered_views(views, assets=rows), "views") if condition is not None or access is not None else views
    for name, asked, weight in [*([("vector", queries, vector_weight)] if vector_weight else []), *vectors]:
        asked = asked.filter("vector is not null").select("query_id", "vector")
        if collapse:
            leg = vector_collapsed(seen, asked, hashes, most)
            sizes.append(vector_sizes(seen.join(hashes, "asset_id"), asked, group=_hash_key("asset_id")))
        else:
            leg = vector_top(seen, asked, most)
            sizes.append(vector_sizes(seen, asked))
        top = leg_window(leg.withColumn("score", engine_score(F.col("score"))), start, size, window)
        top = top if cutoff_threshold is None else cutoff(top, cutoff_threshold)
        legs.append((name, with_views(top, seen, asked) if explain else top, weight))
    fused = rrf_fuse(legs, k)
    fused = similarity_dedup(fused, first_views(views), dedup)
    page = paginate(fused, start, size, sizes=sizes)
    page = explain_scores(page) if explain else page
    if enrich:
        page = reduce(lambda df, add: add(df), enrich, page.join(assets.select("asset_id", "base_key"), "asset_id", "left"))
    return page


def distances(hits: DataFrame, vectors: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Cosine distance of neighbouring hits of a query by rank, as R12 sees them."""
    v = hits.join(vectors, id_col)
    a = v.select("query_id", F.col("rank"), F.col("vector").alias("a"))
    b = v.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("vector").alias("b"))
    return a.join(b, ["query_id", "rank"]).select("query_id", "rank", cosine_distance(F.col("a"), F.col("b")).alias("distance"))
