"""Keyed tables: cut lineage, upserts, merges, deletes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from orrery.functions.documents import deep_merge


def shared_dir(df_or_spark) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names. In local mode a temporary one is set if it is unset; on a cluster that is an error."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: computed once, whatever reads it, and kept when an executor is lost."""
    path = f"{shared_dir(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dimension(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast after a look at its size; a table of settings with more rows than most is an error, as every row of the other side meets all of it."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of settings with more than {most} rows")
    return F.broadcast(df)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer files than there are cores, for costly work on every row; select what is needed first.

    A table in more files is left as it is, so that a large one isn't shuffled. The rows are the same either way. Names of files stay in the JVM.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df._jdf.inputFiles()) < cores else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df))
    return df.checkpoint()


def latest(updates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last update of each key."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return updates.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Whole rows replaced by key; updates hold a key once (see latest)."""
    return target.join(updates.select(key), key, "left_anti").select(*target.columns).unionByName(updates.select(*target.columns))


def update_meta(target: DataFrame, partial: DataFrame, key: str) -> DataFrame:
    """Given fields overwrite, others stay; missing keys are inserted. partial may have a subset of the columns; null means not given."""
    p = partial.select(F.col(key), *(F.col(c).alias(f"_new_{c}") for c in partial.columns if c != key))
    return target.join(p, key, "full_outer").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) if c in partial.columns else F.col(c) for c in target.columns if c != key))


def merge_nested(target: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Deep merge of a document column of any depth: given keys overwrite, others stay, at every level (see deep_merge); keys of rows that aren't there yet are inserted, with nulls in other columns.

    The column is a VARIANT, a string of JSON, or map<string, map<string, string>>, and stays so. updates hold a key
    once; of other columns they have, the target's are kept.
    """
    kind = target.schema[column].dataType
    u = updates.select(F.col(key), F.col(column).alias("_u"))
    if isinstance(kind, MapType):
        empty = F.create_map().cast("map<string,string>")
        inner = lambda a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(y, x))
        outer = F.create_map().cast("map<string,map<string,string>>")
        merged = F.map_zip_with(F.coalesce(F.col(column), outer), F.coalesce(F.col("_u"), outer), lambda k, a, b: inner(a, b))
    elif isinstance(kind, StringType):
        merged = F.to_json(deep_merge(F.parse_json(column), F.parse_json("_u")))
    else:
        merged = deep_merge(F.col(column), F.col("_u"))
    return target.join(u, key, "full_outer").withColumn(column, merged).drop("_u").select(*target.columns)


def delete_items(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Missing keys are ignored."""
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)


def copy_items(target: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """pairs(src, dst); dst gets all of src's content, replacing its own."""
    copied = target.join(pairs, F.col(key) == F.col("src")).withColumn(key, F.col("dst")).select(*target.columns)
    return upsert(target, copied, key)


def scan_keys(target: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """S15."""
    return (target if condition is None else target.filter(condition)).select(key)


def get_items(target: DataFrame, keys: DataFrame, key: str, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """The rows of the keys with chosen columns and found; keys that are missing have nulls and found false."""
    columns = [c for c in (include or target.columns) if c not in exclude and c != key]
    return keys.select(key).distinct().join(target.select(key, *columns).withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
