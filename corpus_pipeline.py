"""From raw documents to packed training sequences, in five stages.

Every stage reads what the one before wrote. All but the last return the columns of documents: bad
documents go, one document of each group of near duplicates stays, passages that repeat across documents
are cut from all but the first, contaminated documents go, and the rest is packed into windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, neardup, packing, quality, suffixdedup
from orrery.llm.common import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, learned from all labels; documents that score under the operator's threshold of 0.7 go.

    Null, empty and blank texts score as a text without words does. Rows that share an id, or have none, are judged
    each by its own text. Without labels all stay; an empty table gives no rows.
    """
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 over five words and a similarity of 0.8; the least doc_id of each group stays, once.

    A document is an id with a text: rows that share an id but not a text are judged each for itself, and so are
    rows without an id, which come after all ids of their group. Rows alike in both are one document; null
    and empty texts are alike by id and text only. Other columns stay, whatever their names.
    """
    node = f"node_{uuid.uuid4().hex}"
    nodes = docs.withColumn(node, F.xxhash64("doc_id", "text"))
    groups = neardup.near_duplicates(nodes, id_col=node).select(F.col("doc_id").alias(node), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(node).alias("node"))
    first = groups.join(nodes.select(node, "doc_id").distinct(), node).groupBy("component_id").agg(F.min(order).alias("first"))
    kept = nodes.join(first.select(F.col("first.node").alias(node)), node, "left_semi")
    return kept.dropDuplicates([node, "doc_id", "text"]).select(*(F.col(f"`{c}`") for c in docs.columns))


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7; texts lose what a smaller doc_id has too, and n_chars follows. Documents stay, if need be with an empty text.

    Null texts stay null. Rows without an id count as less than all ids; rows that share one lose nothing to each other.
    """
    out = suffixdedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; contaminated documents go. Null and empty texts stay; each row is judged by its own text."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Null and empty texts are the end token alone; every row is packed, whatever its id."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("repeated_passages", no_repeated_passages),
    ("decontamination", no_benchmark_passages),
    ("packing", packed),
]

#: SQL can't express a trained classifier or a tokenizer; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
