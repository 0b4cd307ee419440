"""Listings, changes, scene documents, material references and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.exprs import extension, normalize_url
from orrery.operators.predicates import literal_prefix
from orrery.sources.tables import shared_dir

# What is indexed and what never is.
FORMATS = ["usd", "usda", "usdc", "usdz", "gltf", "glb", "fbx", "obj", "stl", "ply", "abc", "mdl", "mtlx", "bmp", "gif", "hdr", "jpeg", "jpg", "png", "tif", "tiff", "webp"]
JUNK_FOLDERS = [".git", "__pycache__", ".DS_Store"]


def list_assets(spark: SparkSession, root: str, ignore: list[str] = (), show_hidden: bool = False) -> DataFrame:
    """Uri, size and modified of every file under root; content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return filter_listing(files, ignore, show_hidden)


def filter_listing(listing: DataFrame, ignore: list[str] = (), show_hidden: bool = False) -> DataFrame:
    """S1 on a listing table: folders (keys ending in /), ignored patterns and hidden parts go."""
    out = listing.filter(~F.col("uri").endswith("/"))
    for p in ignore:
        out = out.filter(~F.col("uri").rlike(p))
    return out if show_hidden else out.filter(~F.col("uri").rlike(r"/\.[^/]"))


def change_hash(uri: Column, modified: Column, stored: Column) -> Column:
    """The storage's hash, else uri/modified."""
    return F.coalesce(stored, F.concat(uri, F.lit("/"), modified.cast("string")))


def rescan_as_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(uri, hash_value) snapshots to create, update and delete events."""
    p = previous.select("uri", F.col("hash_value").alias("_old"))
    c = current.select("uri", F.col("hash_value").alias("_new"))
    event = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    return p.join(c, "uri", "full_outer").select("uri", event.alias("event"), F.coalesce("_new", "_old").alias("hash_value")).filter("event is not null")


def include_exclude(changes: DataFrame, include: list[str] = (), exclude: list[str] = (), column: str = "uri") -> DataFrame:
    """Matches are anchored at the beginning; exclusion wins; without an include list everything else stays."""
    c = F.col(column)
    match = lambda ps: reduce(lambda a, b: a | b, [c.rlike(f"^(?:{p})") for p in ps])
    out = changes
    if include:
        out = out.filter(match(include))
    if exclude:
        out = out.filter(~match(exclude))
    return out


def listing_under(listing: DataFrame, pattern: str) -> DataFrame:
    """A wildcard listing with the literal prefix as a condition of its own, which reaches the scan."""
    from orrery.operators.predicates import like

    return listing.filter(F.col("uri").startswith(literal_prefix(pattern)) & like(F.col("uri"), pattern, False))


def supported(changes: DataFrame, formats: list[str] = FORMATS, junk: list[str] = JUNK_FOLDERS, excluded: list[str] = ()) -> DataFrame:
    """Supported extensions, no hidden parts, no junk folders, no excluded substrings."""
    parts = F.split("uri", "/")
    out = changes.filter(extension(F.col("uri")).isin(formats)).filter(~F.exists(parts, lambda p: p.isin(junk) | (p.startswith(".") & (p != ".") & (p != ".."))))
    for x in excluded:
        out = out.filter(~F.contains("uri", F.lit(x)))
    return out


def asset_metadata(changes: DataFrame) -> DataFrame:
    """What a change record says about its asset."""
    uri = F.col("uri")
    return changes.select(uri.alias("base_key"), F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "").alias("path"), F.substring_index(uri, "/", -1).alias("name"), extension(uri).alias("ext"), "size", "ts", change_hash(uri, F.col("ts"), F.col("hash_value")).alias("hash_value"))


SCENE = "scene_url string, default_prim_path string, scene_mpu double, scene_up_axis string, assets array<struct<url:string,size:long>>, asset_relationships array<struct<node_1_url:string,node_2_url:string,type:string>>, prims map<string,struct<prim_type:string,source_asset_url:string,polygon_count:long>>"


def ingest_scenes(scenes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scene documents (schema SCENE) to assets, edges and prims; the default prim is marked, prims carry the scene's metres per unit."""
    own = F.struct(F.col("scene_url").alias("url"), F.lit(None).cast("long").alias("size"))  # a scene is an asset too; documents are read once
    assets = scenes.select(F.explode(F.concat(F.array(own), F.coalesce("assets", F.array().cast("array<struct<url:string,size:long>>")))).alias("a")).select("a.*").groupBy("url").agg(F.max("size").alias("size"))
    edges = scenes.select("scene_url", F.explode("asset_relationships").alias("r")).select(F.col("r.node_1_url").alias("src"), F.col("r.node_2_url").alias("dst"), F.col("r.type").alias("type"), "scene_url")
    prims = scenes.select("scene_url", "default_prim_path", "scene_mpu", F.explode("prims").alias("usd_path", "p")).select("scene_url", "usd_path", "p.*", "scene_mpu", (F.col("usd_path") == F.col("default_prim_path")).alias("default_prim"))
    return assets, edges, prims


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENE).json(path)


def replace_scenes(new: DataFrame, path: str) -> None:
    """Write prims or edges partitioned by scene; a scene that is written again replaces its own rows only, so a reload is idempotent."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_url").parquet(path)


def replace_rows(table: DataFrame, new: DataFrame, key: str = "scene_url") -> DataFrame:
    """S9 on tables: all rows of the new rows' keys go, then the new rows come."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def material_references(files: DataFrame) -> DataFrame:
    """files(url, content): quoted texture and module references, resolved against the file: (src, dst)."""
    found = F.regexp_extract_all("content", F.lit(r'"([^"\n]+\.(?:png|jpg|jpeg|exr|mdl|tif))"'), F.lit(1))
    return files.select(F.col("url").alias("src"), F.explode(found).alias("ref")).select("src", normalize_url(F.col("src"), F.col("ref")).alias("dst")).filter("src <> dst").distinct()


# Tags as rows (path, namespace, tag, value)


def apply_tag_actions(tags: DataFrame, actions: DataFrame) -> DataFrame:
    """actions(seq, path, namespace, tag, value, action). In order of seq: reset empties the namespace of a path and sets the tag; add sets it if it is not there; set sets it; remove takes it away. Blank tags are left out. Resets of one path and namespace with one seq go together."""
    a = actions.filter("trim(coalesce(tag, '')) <> '' or action = 'reset'")
    w = Window.partitionBy("path", "namespace")
    base = tags.select(F.lit(-1).cast("long").alias("seq"), "path", "namespace", "tag", "value", F.lit("set").alias("action"))
    rows = base.unionByName(a.select(F.col("seq").cast("long").alias("seq"), "path", "namespace", "tag", "value", "action"))
    rows = rows.withColumn("_reset", F.max(F.when(F.col("action") == "reset", F.col("seq"))).over(w)).filter("_reset is null or seq >= _reset").filter("trim(coalesce(tag, '')) <> ''")
    # an add counts only if the tag was not there: no set, reset or earlier add since the last removal
    key = Window.partitionBy("path", "namespace", "tag").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.last(F.when(F.col("action") == "remove", 0).otherwise(1)).over(key), F.lit(0))
    rows = rows.withColumn("_skip", (F.col("action") == "add") & (before == 1)).filter("not _skip")
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path", "namespace", "tag").orderBy(F.desc("seq")))).filter("_r = 1 and action <> 'remove'")
    return last.select("path", "namespace", "tag", "value")


def predicted_tags(predictions: DataFrame, namespace: str) -> DataFrame:
    """predictions(seq, path, tag, value) reset the generated namespace of their path."""
    return predictions.filter("trim(coalesce(tag, '')) <> ''").select("seq", "path", F.lit(f".{namespace}.generated").alias("namespace"), "tag", "value", F.lit("reset").alias("action"))


def clear_namespaces(tags: DataFrame, paths: DataFrame, namespaces: list[str]) -> DataFrame:
    """T2."""
    gone = paths.select("path").distinct().withColumn("_gone", F.lit(True))
    return tags.join(gone, "path", "left").filter(~(F.coalesce("_gone", F.lit(False)) & F.col("namespace").isin(namespaces))).select(*tags.columns)


def tagged_paths(tags: DataFrame, tag: str | None = None, namespace: str | None = None, under: str = "") -> DataFrame:
    """T3."""
    out = tags.filter(F.col("path").startswith(under))
    if tag is not None:
        out = out.filter(F.col("tag") == tag)
    if namespace is not None:
        out = out.filter(F.col("namespace") == namespace)
    return out.select("path").distinct()


def copy_tags(tags: DataFrame, old: str, new: str) -> DataFrame:
    """T4: tags of the old namespace also in the new one; what is there already stays."""
    copied = tags.filter(F.col("namespace") == old).withColumn("namespace", F.lit(new)).join(tags.filter(F.col("namespace") == new).select("path", "tag"), ["path", "tag"], "left_anti")
    return tags.unionByName(copied.select(*tags.columns))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
