"""Reachability over edge tables by a frontier that is joined level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.tables import written


def swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def dependency_levels(edges: DataFrame, roots: DataFrame, max_level: int | None = None) -> DataFrame:
    """(root, node, level) with the level at which a node is first reached; the root itself is level 0. Safe with cycles; roots(root).

    Edges are written once, ordered by src within each task, and every level reads from them what its frontier asks for.
    """
    e = written(edges.select("src", "dst").distinct().sortWithinPartitions("src"), "edges")
    frontier = roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("level")).distinct()
    seen, level = frontier, 0
    while max_level is None or level < max_level:
        level += 1
        step = frontier.select("root", F.col("node").alias("src")).join(e, "src").select("root", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def dependencies_flat(edges: DataFrame, roots: DataFrame, max_level: int | None = None, limit: int | None = None) -> DataFrame:
    """G1: everything reached, roots left out; a limit takes the first of each root by level and name."""
    out = dependency_levels(edges, roots, max_level).filter("level > 0 and node <> root")
    return _limited(out, limit)


def dependencies_inverse(edges: DataFrame, roots: DataFrame, max_level: int | None = None, limit: int | None = None) -> DataFrame:
    """Where the roots are used."""
    return dependencies_flat(swapped(edges), roots, max_level, limit)


def _limited(levels: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return levels
    w = Window.partitionBy("root").orderBy("level", "node")
    return levels.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair."""
    rest = [F.min(c).alias(c) for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(*rest) if rest else edges.select("src", "dst").distinct()


def dependency_graph(edges: DataFrame, roots: DataFrame, max_level: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) induced on what is reached, root included, by root."""
    nodes = written(_limited(dependency_levels(edges, roots, max_level), limit), "nodes")
    e = unique_edges(edges.select("src", "dst"))
    inside = nodes.select("root", F.col("node").alias("src")).join(e, "src").join(nodes.select("root", F.col("node").alias("dst")), ["root", "dst"], "left_semi")
    return nodes, inside.select("root", "src", "dst")


def inverse_dependency_graph(edges: DataFrame, roots: DataFrame, max_level: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """G3 over reversed edges; edges keep their own direction."""
    nodes, inside = dependency_graph(swapped(edges), roots, max_level, limit)
    return nodes, inside.select("root", F.col("dst").alias("src"), F.col("src").alias("dst"))


def delete_assets(assets: DataFrame, edges: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assets(url, deleted), urls(url). What others depend on is only flagged; the rest goes with its edges."""
    used = urls.join(edges.select(F.col("dst").alias("url")), "url", "left_semi").distinct()
    gone = urls.join(used, "url", "left_anti").distinct()
    kept = assets.join(gone, "url", "left_anti").join(used.withColumn("_used", F.lit(True)), "url", "left").withColumn("deleted", F.coalesce("_used", "deleted", F.lit(False))).drop("_used")
    left = edges.join(gone.withColumnRenamed("url", "src"), "src", "left_anti").join(gone.withColumnRenamed("url", "dst"), "dst", "left_anti").select(*edges.columns)
    return kept, left


def delete_subgraph(assets: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The assets without what the roots depend on (roots stay)."""
    reached = dependencies_flat(edges, roots).select(F.col("node").alias("url")).distinct()
    return assets.join(reached, "url", "left_anti")


def prim_subtree(prims: DataFrame, prefix: str, whole_names: bool = False) -> DataFrame:
    """Plain prefix; whole_names takes the prim and what lies under it."""
    p = F.col("usd_path")
    return prims.filter((p == prefix) | p.startswith(prefix.rstrip("/") + "/") if whole_names else p.startswith(prefix))


def unique_refs(edges: DataFrame) -> DataFrame:
    """G9."""
    return edges.select(F.col("dst").alias("ref")).distinct()


def dependency_edges(files: DataFrame) -> DataFrame:
    """files(url, refs) to edges; relative references are resolved, references to oneself left out."""
    from orrery.functions.exprs import normalize_url

    refs = files.select(F.col("url").alias("src"), F.explode("refs").alias("ref"))
    return refs.select("src", normalize_url(F.col("src"), F.col("ref")).alias("dst")).filter("src <> dst").distinct().withColumn("type", F.lit("depends_on"))


def all_nodes(nodes: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """U4: nodes, both ends of edges, and the root."""
    out = nodes.select("node").union(edges.select("src")).union(edges.select("dst"))
    if root is not None:
        out = out.union(nodes.sparkSession.createDataFrame([(root,)], "node string"))
    return out.distinct()


def bundle_manifest(edges: DataFrame, assets: DataFrame, roots: DataFrame, access: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """A row per root and file: included or the reason it isn't, archive path, totals. assets(url, size, deleted); access(url).

    Archive paths leave out the folder that all included files share; equal ones get a number before the extension.
    """
    from orrery.functions.exprs import archive_path

    files = dependency_levels(edges, roots).select("root", F.col("node").alias("url"))
    met = files.join(assets.select("url", "size", "deleted"), "url", "left").join(access.select("url").distinct().withColumn("_ok", F.lit(True)), "url", "left")
    reason = F.when(F.col("size").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("_ok").isNull(), "no access")
    rows = met.withColumn("reason", reason).drop("_ok")
    good = rows.filter("reason is null")
    folder = F.regexp_replace("url", r"[^/]*$", "")
    # the longest common prefix of all names is that of the least and the greatest
    ends = good.groupBy("root").agg(F.min(folder).alias("a"), F.max(folder).alias("b"), F.sum("size").alias("total_size"), F.count("*").alias("total_files"))
    same = F.expr("aggregate(sequence(1, greatest(1, least(length(a), length(b)))), 0, (n, i) -> if(n = i - 1 and substring(a, i, 1) = substring(b, i, 1) and i <= least(length(a), length(b)), i, n))")
    ends = ends.withColumn("n", same).withColumn("common", F.regexp_replace(F.expr("substring(a, 1, n)"), r"[^/]*$", ""))
    placed = good.join(ends.select("root", "common"), "root").withColumn("path", archive_path(F.col("url"), F.col("common")))
    w = Window.partitionBy("root", "path").orderBy("url")
    placed = placed.withColumn("k", F.row_number().over(w))
    named = F.when(F.col("k") == 1, F.col("path")).otherwise(F.regexp_replace("path", r"(\.[^./]*)?$", "")).alias("p")
    suffix = F.when(F.col("k") > 1, F.concat(F.lit("_"), (F.col("k") - 1).cast("string"), F.regexp_extract("path", r"(\.[^./]*)$", 1))).otherwise("")
    placed = placed.withColumn("archive_path", F.concat(named, suffix)).select("root", "url", "archive_path")
    out = rows.join(placed, ["root", "url"], "left").join(ends.select("root", "total_size", "total_files"), "root", "left")
    if most_bytes is not None:
        out = out.withColumn("too_large", F.coalesce(F.col("total_size") > most_bytes, F.lit(False)))
    return out.drop("deleted")
