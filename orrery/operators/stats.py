"""Corpus statistics, catalogs, and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.exprs import infer_value_type, slug
from orrery.operators.predicates import global_rank
from orrery.sources.tables import dimension


def exploded(assets: DataFrame, column: str = "props", id_col: str = "asset_id") -> DataFrame:
    return assets.select(id_col, F.explode(column).alias("p")).select(id_col, F.col("p.name").alias("key"), F.col("p.value").alias("value"))


def property_stats(assets: DataFrame, column: str = "props", id_col: str = "asset_id") -> DataFrame:
    """A1 to A3 in one pass: level (keys, values, pairs), key, value, n (nested elements) and n_assets; A1 is level keys, and so on."""
    p = exploded(assets, column, id_col)
    key, value = F.col("key"), F.col("value")
    g = p.groupingSets([[key], [value], [key, value]], key, value).agg(F.grouping("key").alias("gk"), F.grouping("value").alias("gv"), F.count("*").alias("n"), F.countDistinct(id_col).alias("n_assets"))
    level = F.when(F.col("gv") == 1, "keys").when(F.col("gk") == 1, "values").otherwise("pairs")
    return g.select(level.alias("level"), "key", "value", "n", "n_assets")


def by_count(stats: DataFrame) -> DataFrame:
    """By count downwards, then by key and value."""
    return stats.orderBy(F.desc("n"), "key", "value")


def page_after(stats: DataFrame, size: int, after: str | None = None, key: str = "key") -> DataFrame:
    """A4: the next page of keys behind `after`."""
    return (stats if after is None else stats.filter(F.col(key) > after)).orderBy(key).limit(size)


def keyword_histogram(views: DataFrame, view_filter: Column | None = None, assets: DataFrame | None = None, id_col: str = "asset_id") -> DataFrame:
    """A5: keyword, documents that have it in some view, and views."""
    rows = views if view_filter is None else views.filter(view_filter)
    if assets is not None:
        rows = rows.join(assets.select(id_col), id_col, "left_semi")
    return rows.select(id_col, F.explode("keyword").alias("keyword")).groupBy("keyword").agg(F.countDistinct(id_col).alias("documents"), F.count("*").alias("n"))


def distinct_keywords(views: DataFrame) -> DataFrame:
    """A6."""
    return views.select(F.explode("keyword").alias("keyword")).distinct()


def property_catalog(assets: DataFrame, top: int = 5, column: str = "props", id_col: str = "asset_id") -> DataFrame:
    """Key, n_assets, cardinality, kind, top values (by count, then value), place by coverage."""
    p = exploded(assets, column, id_col)
    pairs = p.groupBy("key", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    best = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("top_values"))
    keys = pairs.groupBy("key").agg(F.count("*").alias("cardinality"), infer_value_type(F.col("value")).alias("kind"))
    n = p.groupBy("key").agg(F.countDistinct(id_col).alias("n_assets"))
    return global_rank(keys.join(n, "key").join(best, "key"), F.desc("n_assets"), F.col("key"), name="place")


def derive_filter_fields(catalog: DataFrame, top: int = 40, most_values: int = 50, reserved: list[str] = ()) -> DataFrame:
    """A10: the first keys by coverage as fields; strings of too many values are left out; slugs that collide or are reserved get a checksum."""
    kept = catalog.filter(~((F.col("kind") == "string") & (F.col("cardinality") > most_values))).orderBy("place").limit(top)
    named = kept.withColumn("slug", slug(F.col("key")))
    w = Window.partitionBy("slug").orderBy("place")
    clash = (F.row_number().over(w) > 1) | F.col("slug").isin(list(reserved) or [""])
    name = F.when(clash, F.concat("slug", F.lit("_"), F.lower(F.hex(F.crc32(F.col("key").cast("binary")))))).otherwise(F.col("slug"))
    operators = F.when(F.col("kind") == "number", F.array(*map(F.lit, ("=", ">", ">=", "<", "<=")))).when(F.col("kind") == "boolean", F.array(F.lit("="))).otherwise(F.array(F.lit("="), F.lit("~")))
    return named.select("key", name.alias("field"), F.when(F.col("kind") == "number", "numeric").otherwise("property").alias("kind"), operators.alias("operators"))


def target_audit(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(concept, pattern, recommended): present, and the best key: the recommended one if it matches, else of the highest coverage."""
    # the catalog stays dealt over tasks; the concepts, a table of settings whose size is checked, go to each
    met = catalog.select("key", "n_assets").join(dimension(targets), F.expr("key rlike concat('(?i)', pattern)"))
    best = met.groupBy("concept").agg(F.max_by("key", F.struct(F.col("key") == F.col("recommended"), "n_assets", F.col("key"))).alias("best_key"))
    return targets.join(best, "concept", "left").select("concept", F.col("best_key").isNotNull().alias("present"), "best_key")


def property_grounding(catalog: DataFrame, keys: int = 50, values: int = 8, most_cardinality: int = 20) -> DataFrame:
    """A line for each of the first keys: "number", its values, or "free text"."""
    text = F.when(F.col("kind") == "number", "number").when(F.col("cardinality") <= most_cardinality, F.concat_ws(" | ", F.slice("top_values", 1, values))).otherwise("free text")
    return catalog.filter(F.col("place") <= keys).select("place", F.concat("key", F.lit(": "), text).alias("line"))


def latest_status(status: DataFrame) -> DataFrame:
    w = Window.partitionBy("plugin", "uri").orderBy(F.desc("processing_timestamp"))
    return status.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def assets_by_status(listing: DataFrame, plugins: DataFrame, status: DataFrame, include: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """Status, uri and its plugins; "missing" where a plugin never reported. plugins: a table of settings, its size is checked."""
    pairs = listing.select("uri").distinct().join(dimension(plugins.select(F.col("name").alias("plugin"))))
    found = pairs.join(latest_status(status).select("plugin", "uri", "status"), ["plugin", "uri"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    if include is not None:
        found = found.filter(F.col("status").isin(include))
    if exclude:
        found = found.filter(~F.col("status").isin(list(exclude)))
    return found.groupBy("status", "uri").agg(F.array_sort(F.collect_set("plugin")).alias("plugins"))


def index_size(**tables: DataFrame) -> DataFrame:
    """Rows of every store."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def consumer_progress(log: DataFrame, acks: DataFrame) -> DataFrame:
    """log(seq), acks(consumer, seq, done): read, processed, lag behind the log, percent done."""
    total = log.agg(F.count("*").alias("total"))
    g = acks.groupBy("consumer").agg(F.count("*").alias("read"), F.count_if("done").alias("processed"))
    return g.join(F.broadcast(total)).select("consumer", "read", "processed", (F.col("total") - F.col("read")).alias("lag"), (100.0 * F.col("processed") / F.greatest("total", F.lit(1))).alias("percent"))
