"""Offline retrieval evaluation over tables of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.retrieval import small
from orrery.sources.tables import written


def holding(docs: DataFrame, items: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """(query_id, id): docs(id, text) whose text holds that of items(query_id, q) as it is.

    An equi-join on an item's longest inner word, which any text that holds it has as a word of its own, then a
    check. Items of fewer than three words have no inner word and are looked for in every text, a checked number at a time.
    """
    words = F.split("q", " ")
    inner = F.array_max(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    items = written(items.filter("q is not null").withColumn("word", inner["word"]), "items")
    long = items.filter("word is not null")
    met = docs.select(id_col, "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(small(long), "word")
    short = small(items.filter("word is null"))
    found = met.unionByName(docs.select(id_col, "text").join(short)) if not items.filter("word is null").isEmpty() else met
    return found.filter(F.contains("text", "q")).select("query_id", id_col)


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, groups: list[str] = ("config_id", "query_class")) -> DataFrame:
    """run(config_id, query_id, query_class, asset_id, rank), qrels(query_id, asset_id, grade): mean precision@k, recall@k, MRR, NDCG@k of queries with judgments."""
    groups = list(groups)
    run, relevant = written(run, "run"), written(qrels.filter("grade > 0"), "qrels")
    n = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "asset_id")
    ideal = relevant.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("query_id").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("r") + 1.0)).alias("ideal"))
    asked = run.select(*groups, "query_id").distinct().join(n, "query_id").join(ideal, "query_id")
    hits = run.filter(F.col("rank") <= k).join(relevant, ["query_id", "asset_id"]).groupBy(*groups, "query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1.0)).alias("gain"))
    each = asked.join(hits, [*groups, "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.groupBy(*groups).agg(F.count("*").alias("queries"), F.avg(zero(F.col("hits") / k)).alias("precision"), F.avg(zero(F.col("hits") / F.col("relevant"))).alias("recall"), F.avg(zero(1.0 / F.col("first"))).alias("mrr"), F.avg(zero(F.col("gain") / F.col("ideal"))).alias("ndcg"))


def config_sweep(legs: DataFrame, configs: DataFrame) -> DataFrame:
    """legs(query_id, query_class, asset_id, leg, n, rank) fused under every config(config_id, rank_constant, window_size, text_weight, vector_weight). configs: a table of settings, a row each."""
    met = legs.join(small(configs), F.col("rank") <= F.col("window_size"))
    weight = F.when(F.col("leg") == "text", F.col("text_weight")).otherwise(F.col("vector_weight"))
    fused = met.groupBy("config_id", "query_id", "query_class", "asset_id").agg(F.sum(weight / (F.col("rank") + F.col("rank_constant"))).alias("rrf_score"), F.min(F.struct("n", "rank")).alias("first"))
    w = Window.partitionBy("config_id", "query_id").orderBy(F.desc(F.round("rrf_score", 12)), "first", "asset_id")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")


def deltas(metrics: DataFrame, baseline: str, columns: list[str] = ("precision", "recall", "mrr", "ndcg")) -> DataFrame:
    """Each config's metrics less the baseline's, by class."""
    base = metrics.filter(F.col("config_id") == baseline).select("query_class", *(F.col(c).alias(f"_{c}") for c in columns))
    return metrics.join(base, "query_class").select("config_id", "query_class", *((F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in columns))


def judgment_pool(runs: DataFrame, judged: DataFrame, model: str, k: int = 10) -> DataFrame:
    """(query_id, asset_id) in the first k of any run that the model hasn't judged."""
    pool = runs.filter(F.col("rank") <= k).select("query_id", "asset_id").distinct()
    return pool.join(judged.filter(F.col("model") == model), ["query_id", "asset_id"], "left_anti")


def leg_diagnosis(a: DataFrame, b: DataFrame) -> DataFrame:
    """Explanations of two configs (query_id, asset_id, leg, leg_rank, part): how each leg's rank and contribution moved; a leg on one side only has nulls."""
    keys = ["query_id", "asset_id", "leg"]
    x = a.select(*keys, F.col("leg_rank").alias("rank_a"), F.col("part").alias("part_a"))
    y = b.select(*keys, F.col("leg_rank").alias("rank_b"), F.col("part").alias("part_b"))
    return x.join(y, keys, "full_outer").withColumn("rank_delta", F.col("rank_b") - F.col("rank_a")).withColumn("part_delta", F.coalesce("part_b", F.lit(0.0)) - F.coalesce("part_a", F.lit(0.0)))


def mean_similarity(leg: DataFrame) -> DataFrame:
    """Mean vector similarity of a query's hits."""
    return leg.groupBy("query_id").agg(F.avg("score").alias("mean_similarity"))
