"""Bounded samples of labelled rows, on which models are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for rows without an id, which are neither learned from nor held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sample_per_label(rows: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most `most` ids of each label, the ones of least hash: (id, label). Each task passes on no more than that."""
    w = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null").dropDuplicates(["id", "label"])
    return picked.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def sampled_texts(documents: DataFrame, sample: DataFrame, id_col: str, text_col: str, parts: int = 12) -> DataFrame:
    """(id, label, text) of a bounded sample, whose ids are broadcast."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return docs.join(F.broadcast(sample), "id").select("id", "label", "text").repartition(parts, "id")
