"""Joins of hits and assets with what belongs to them, window samples, reconciliation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.graph import dependencies_flat


def in_scene(assets: DataFrame, edges: DataFrame, scenes: DataFrame, key: str = "base_key") -> DataFrame:
    """Assets that the scenes(root) depend on; an empty closure keeps nothing."""
    return assets.join(dependencies_flat(edges, scenes).select(F.col("node").alias(key)).distinct(), key, "left_semi")


def accessible(hits: DataFrame, access: DataFrame, limit: int | None = None, key: str = "base_key") -> DataFrame:
    """Verified rows, then the limit of each query by rank."""
    out = hits.join(access.select(key), key, "left_semi")
    if limit is None:
        return out
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("_r") <= limit).drop("_r")


def accessible_graph(nodes: DataFrame, edges: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """access(node); edges need both ends."""
    a = access.select("node")
    kept = edges.join(a.withColumnRenamed("node", "src"), "src", "left_semi").join(a.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes.join(a, "node", "left_semi"), kept.select(*edges.columns)


def with_instances(hits: DataFrame, prims: DataFrame, scene_url: str | None = None, most: int = 100) -> DataFrame:
    """The first `most` prims by path (in a scene, if given) whose source asset is the hit, and their number."""
    p = prims if scene_url is None else prims.filter(F.col("scene_url") == scene_url)
    w = Window.partitionBy("source_asset_url").orderBy("scene_url", "usd_path")
    first = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).groupBy(F.col("source_asset_url").alias("base_key")).agg(F.array_sort(F.collect_list(F.struct("scene_url", "usd_path"))).alias("instances"))
    n = p.groupBy(F.col("source_asset_url").alias("base_key")).agg(F.count("*").alias("n_instances"))
    return hits.join(first, "base_key", "left").join(n, "base_key", "left").withColumn("n_instances", F.coalesce("n_instances", F.lit(0)))


def with_scene_prims(hits: DataFrame, prims: DataFrame) -> DataFrame:
    """The root and default prims of the hit's own scene."""
    marked = prims.filter("root_prim or default_prim").groupBy(F.col("scene_url").alias("base_key")).agg(F.array_sort(F.collect_list(F.when(F.col("root_prim"), F.col("usd_path")))).alias("root_prims"), F.min(F.when(F.col("default_prim"), F.col("usd_path"))).alias("default_prim"))
    return hits.join(marked, "base_key", "left")


def hit_images(hits: DataFrame, views: DataFrame) -> DataFrame:
    """The best matching view's image, else the first view's. hits(asset_id, view_offset or null)."""
    first = views.groupBy("asset_id").agg(F.min_by("image", "view_offset").alias("_first"))
    best = views.select("asset_id", "view_offset", F.col("image").alias("_best"))
    return hits.join(best, ["asset_id", "view_offset"], "left").join(first, "asset_id", "left").withColumn("image", F.coalesce("_best", "_first")).drop("_best", "_first")


def image_by_offset(wanted: DataFrame, views: DataFrame) -> DataFrame:
    """wanted(asset_id, view_offset): image, or error where there is none."""
    out = wanted.join(views.select("asset_id", "view_offset", "image"), ["asset_id", "view_offset"], "left")
    return out.withColumn("error", F.when(F.col("image").isNull(), F.lit("no such view")))


def keys_exist(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """J9."""
    return keys.select(key).distinct().join(table.select(key).distinct().withColumn("_there", F.lit(True)), key, "left").select(key, F.col("_there").isNotNull().alias("exists"))


def orphans(blobs: DataFrame, views: DataFrame) -> DataFrame:
    """blobs(image) that no view refers to."""
    return blobs.join(views.select("image").distinct(), "image", "left_anti")


def reconcile(indexed: DataFrame, storage: DataFrame, unsupported=None) -> DataFrame:
    """(uri, reason) of rows to remove: missing from storage, or, if a condition is given, unsupported."""
    gone = indexed.join(storage.select("uri"), "uri", "left_anti").select("uri", F.lit("missing").alias("reason"))
    if unsupported is None:
        return gone
    return gone.unionByName(indexed.join(storage.select("uri"), "uri", "left_semi").filter(unsupported).select("uri", F.lit("unsupported").alias("reason")))


def reconcile_cache(cache: DataFrame, assets: DataFrame, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Stale cache rows, and a report (total, stale, percent)."""
    there = assets.select(key).distinct().withColumn("_there", F.lit(True))
    met = cache.join(there, key, "left")
    report = met.agg(F.count("*").alias("total"), F.count_if(F.col("_there").isNull()).alias("stale")).withColumn("percent", 100.0 * F.col("stale") / F.greatest("total", F.lit(1)))
    return met.filter("_there is null").drop("_there"), report


def thumbnails(assets: DataFrame, listing: DataFrame, resolutions: list[int] = (256, 512), suffixes: list[str] = ("", ".auto"), key: str = "base_key") -> DataFrame:
    """Candidate paths dir/.thumbs/RxR/name+suffix.png joined to a listing(uri)."""
    parts = F.array(*(F.concat(F.lit(f"/.thumbs/{r}x{r}/"), F.substring_index(key, "/", -1), F.lit(f"{s}.png")) for r in resolutions for s in suffixes))
    candidates = assets.select(key, F.posexplode(parts).alias("place", "tail")).withColumn("uri", F.concat(F.regexp_replace(key, r"/[^/]*$", ""), "tail"))
    return candidates.join(listing.select("uri"), "uri", "left_semi").select(key, "uri", "place")


def _names_at_segments(pattern: str) -> bool | None:
    """Whether every match of pattern holds the text for {name} literally, right after a slash (True) or anywhere (False); None if it may do without it.

    Told of {name} outside groups and classes, in a pattern without alternatives, quoting or flags, and with nothing
    after it that makes its last letter optional. Anything else counts as None.
    """
    if re.search(r"\\[QE]|\(\?[a-zA-Z-]", pattern):
        return None
    found, depth, in_class = None, 0, 0
    for m in re.finditer(r"\\.|\{name\}[?*{]?|.", pattern, re.DOTALL):
        c = m.group()
        if c in "[]" and (c == "[" or in_class):
            in_class += 1 if c == "[" else -1
        elif in_class:
            continue
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            return None
        elif c == "{name}" and not depth:
            found = bool(found) or pattern[: m.start()].endswith("/")
    return None if in_class or depth else found


def thumbnails_by_pattern(assets: DataFrame, listing: DataFrame, pattern: str, key: str = "base_key") -> DataFrame:
    """J13, regular expression form: {name} stands for the base name; files of the same folder or below its .thumbs are compared.

    If every match holds the name itself, a file tells what names it could match: its pieces without a slash, as long
    as names are, for which the expression holds. These are joined to the assets by folder and name, so a folder's
    assets don't meet all its files. Patterns that may do without the name compare the whole folder.
    """
    folder = lambda c: F.regexp_replace(F.regexp_replace(c, r"/\.thumbs/.*$|/[^/]*$", ""), r"/$", "")
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    regexp = lambda name: F.concat(F.lit("^(?:"), F.replace(F.lit(pattern), F.lit("{name}"), quoted(name)), F.lit(")$"))
    a = assets.select(key, folder(F.col(key)).alias("dir"), F.substring_index(key, "/", -1).alias("_name"))
    files = listing.select("uri", folder(F.col("uri")).alias("dir"))
    begins = _names_at_segments(pattern)
    if begins is None:
        return a.join(files, "dir").filter(F.rlike(F.col("uri"), regexp(F.col("_name")))).select(key, "uri")
    sizes = [r.n for r in a.filter("_name is not null").select(F.length("_name").alias("n")).distinct().collect()]  # a row per length of a name
    sizes = F.array(*map(F.lit, sizes)).cast("array<int>")
    at = lambda part: F.array(F.lit(1)) if begins else F.sequence(F.lit(1), F.length(part) + 1)
    pieces = lambda part: F.flatten(F.transform(at(part), lambda i: F.transform(sizes, lambda n: F.substring(part, i, n))))
    names = F.array_distinct(F.flatten(F.transform(F.split("uri", "/"), pieces)))
    told = files.select("uri", "dir", F.explode(names).alias("_name")).filter(F.rlike(F.col("uri"), regexp(F.col("_name"))))
    return a.join(told, ["dir", "_name"]).select(key, "uri")


def latest_history(status: DataFrame, keep: int = 5) -> DataFrame:
    """The newest statuses of each plugin and uri."""
    w = Window.partitionBy("plugin", "uri").orderBy(F.desc("processing_timestamp"))
    return status.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def by_stream_id(log: DataFrame, column: str = "id") -> DataFrame:
    """Ids ms-seq in the order of both numbers."""
    part = F.split(column, "-")
    return log.orderBy(part[0].cast("long"), part[1].cast("long"))


def stride_sample(rows: DataFrame, group: list[str], order: str, stride: int, most: int) -> DataFrame:
    """Every stride-th row of a group from the first, at most `most`."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w) - 1).filter((F.col("_r") % stride == 0) & (F.col("_r") < stride * most)).drop("_r")


def even_sample(rows: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """K rows at the places (i * n) // k of a group of n; all of a smaller one."""
    w = Window.partitionBy(*group)
    r, n = F.col("_r"), F.col("_n")
    numbered = rows.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # r is floor(i * n / k) for i = ceil(r * k / n), if for any
    i = F.ceil(r * k / n)
    return numbered.filter((n <= k) | ((F.floor(i * n / k) == r) & (i < k))).drop("_r", "_n")


def resample(rows: DataFrame, group: list[str], order: str, size: int, seed: int = 0) -> DataFrame:
    """Exactly `size` rows of each group: a seeded choice of larger ones; smaller ones go round and round."""
    w = Window.partitionBy(*group)
    shuffled = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(order))).withColumn("_r", F.row_number().over(w.orderBy("_h", order)) - 1).withColumn("_n", F.count("*").over(w))
    kept = shuffled.filter(F.col("_r") < size)
    copies = F.expr(f"sequence(0, cast(floor(({size} - 1 - _r) / least(_n, {size})) as int))")
    return kept.withColumn("copy", F.explode(copies)).drop("_h", "_r", "_n")
