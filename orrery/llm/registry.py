"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, decontam, langid, licenses, neardup, packing, quality, resampling, simhash, suffixdedup, toxicity, urlfilter
from .sampling import fold


URL_RULES = [urlfilter.Rule("allow", "org"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1"), urlfilter.Rule("allow", "com", "/fr/"), urlfilter.Rule("block", "com", "/de/")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read(spark, sf_dir, "embeddings")
    return ann.search(embeddings, embeddings.filter("vec_id % 20 = 0"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.train(documents, labels.filter(fold("doc_id", 4) != 2))
    scored = quality.score(documents, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    grammar = toxicity.learn(documents, labels.filter(fold("doc_id", 5) != 0))
    scored = toxicity.score(documents, grammar)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = langid.learn(documents.filter(fold("doc_id", 4) != 2))
    return langid.identify(documents, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_spans(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.longest_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_neardup": op1_neardup, "op2_neighbours": op2_neighbours, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_language": op5_language, "op6_urls": op6_urls, "op7_repeats": op7_repeats, "op8_decontamination": op8_decontamination, "op9_packing": op9_packing, "op10_licenses": op10_licenses, "op11_resampling": op11_resampling, "op12_codes": op12_codes, "op13_simhash": op13_simhash}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.SQL
