"""Asset predicates: a request's flat parameters as column conditions that the scan can push down or Catalyst can reorder."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.exprs import parse_quoted_list, wildcard_regex



def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _null_safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def literal_prefix(pattern: str) -> str:
    """The literal text that a wildcard pattern begins with."""
    return re.split(r"[*?]", pattern)[0]


def like(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """A wildcard match; a case-sensitive one also gives the scan its literal prefix."""
    match = c.rlike(wildcard_regex(pattern, ignore_case))
    prefix = literal_prefix(pattern)
    return match if ignore_case or not prefix else c.startswith(prefix) & match


def groups(spec: str) -> list[list[str]]:
    """; separates groups that all must hold, commas alternatives."""
    return [g for part in spec.split(";") if (g := [t.strip() for t in part.split(",") if t.strip()])]


def wildcard_include(c: Column, spec: str, ignore_case: bool = True) -> Column:
    """P1."""
    return _null_safe(_all([_any([like(c, t, ignore_case) for t in g]) for g in groups(spec)]))


def wildcard_exclude(c: Column, spec: str, ignore_case: bool = True) -> Column:
    """No term of any group may match; rows without a value stay."""
    return ~_null_safe(_any([like(c, t, ignore_case) for g in groups(spec) for t in g]))


def strip_dots(spec: str) -> str:
    """One leading dot of every term goes; *.png stays."""
    return ";".join(",".join(t[1:] if t.startswith(".") else t for t in g) for g in groups(spec))


def extension_include(c: Column, spec: str) -> Column:
    """P3."""
    return wildcard_include(c, strip_dots(spec))


def extension_exclude(c: Column, spec: str) -> Column:
    """P3."""
    return wildcard_exclude(c, strip_dots(spec))


def date_literal(text: str) -> Column:
    if re.fullmatch(r"\d{8}", text):
        text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
    return F.lit(text).cast("timestamp")


def date_range(c: Column, after: str | None = None, before: str | None = None) -> Column:
    """Both ends inclusive; an upper bound without a time holds that whole day."""
    out = []
    if after:
        out.append(c >= date_literal(after))
    if before:
        out.append(c < F.dateadd(date_literal(before).cast("date"), 1).cast("timestamp") if re.fullmatch(r"\d{4}-\d{2}-\d{2}|\d{8}", before) else c <= date_literal(before))
    return _all(out)


def size_literal(text: str) -> int:
    if not (m := re.fullmatch(r"(\d+)([KMGT])B", text)):
        raise ValueError(f"not a size: {text!r}")
    return int(m[1]) * 1024 ** ("KMGT".index(m[2]) + 1)


def size_range(c: Column, least: str | None = None, most: str | None = None) -> Column:
    """P5: both ends inclusive."""
    return _all(([c >= size_literal(least)] if least else []) + ([c <= size_literal(most)] if most else []))


def path_contains(key: Column, spec: str) -> Column:
    """Anywhere in the key, any case; the user's wildcards stay active."""
    return wildcard_include(key, ";".join(",".join(f"*{t}*" for t in g) for g in groups(spec)))


def path_excludes(key: Column, spec: str) -> Column:
    """P6."""
    return wildcard_exclude(key, ";".join(",".join(f"*{t}*" for t in g) for g in groups(spec)))


def user_is(c: Column, user: str) -> Column:
    """P7."""
    return _null_safe(c == user)


def user_is_not(c: Column, user: str) -> Column:
    """P7."""
    return ~_null_safe(c == user)


def url_regexp(c: Column, pattern: str) -> Column:
    """Whole-value match; ~(x) negates. Operators without a Java counterpart are refused."""
    if m := re.fullmatch(r"~\((.*)\)", pattern, re.S):
        return ~_null_safe(url_regexp(c, m[1]))
    if re.search(r"(?<!\\)[&~#@<>]", pattern):
        raise ValueError(f"unsupported operator in {pattern!r}")
    return c.rlike(f"^(?:{pattern})$")


def clauses(spec: str) -> list[tuple[str, str, str]]:
    """(name, operator, value) of a property list: = exact, =~ wildcard; items without = are left out."""
    out = []
    for item in parse_quoted_list(spec):
        if m := re.fullmatch(r"(.*?)(=~|=)(.*)", item, re.S):
            out.append((m[1].strip(), m[2], m[3].strip()))
    return out


def has_element(elements: Column, name: str, op: str, value: str, name_field: str = "name", value_field: str = "value") -> Column:
    """One element satisfies name and value together; an empty side is free."""

    def fits(e: Column) -> Column:
        parts = []
        if name:
            parts.append(e[name_field] == name)
        if value:
            parts.append(e[value_field].rlike(wildcard_regex(value)) if op == "=~" else e[value_field] == value)
        return _all(parts)

    return _null_safe(F.exists(elements, fits))


def properties_all(props: Column, spec: str) -> Column:
    """P9."""
    return _all([has_element(props, *c) for c in clauses(spec)])


def properties_any(props: Column, spec: str) -> Column:
    """P10."""
    return _any([has_element(props, *c) for c in clauses(spec)])


def properties_none(props: Column, spec: str) -> Column:
    """P11."""
    return ~properties_any(props, spec)


_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}


def _numeric_element(props: Column, name: str, op: str, value: float) -> Column:
    return _null_safe(F.exists(props, lambda p: (p["name"] == name) & _COMPARE[op](p["value_numeric"], value)))


def properties_numeric(props: Column, spec: str) -> Column:
    """Name OP number, all clauses; malformed clauses raise."""
    out = []
    for item in parse_quoted_list(spec):
        if not (m := re.fullmatch(r"(.+?)\s*(>=|<=|>|<|=)\s*([+-]?[\d.]+(?:[eE][+-]?\d+)?)", item.strip())):
            raise ValueError(f"malformed numeric clause: {item!r}")
        out.append(_numeric_element(props, m[1], m[2], float(m[3])))
    return _all(out)


def tags_all(tags: Column, spec: str) -> Column:
    """k=, =v, k=v on one element, wildcards in any case; bare words are left out."""

    def one(k: str, v: str) -> Column:
        return _null_safe(F.exists(tags, lambda t: _all(([t["tag"].rlike(wildcard_regex(k))] if k else []) + ([t["value"].rlike(wildcard_regex(v))] if v else []))))

    return _all([one(k, v) for k, _, v in clauses(spec)])


def metadata_matches(vlm: Column, spec: str) -> Column:
    """k=, v or =v, k=v; names exact, values share a token; any plugin's entry, all clauses."""
    entries = F.flatten(F.map_values(vlm))
    out = []
    for item in parse_quoted_list(spec):
        k, _, v = item.rpartition("=") if "=" in item else ("", "", item)
        out.append(_metadata_entry(entries, k.strip(), [w.lower() for w in re.findall(r"\w+", v)]))
    return _all(out)


def _metadata_entry(entries: Column, k: str, wanted: list[str]) -> Column:
    def fits(e: Column) -> Column:
        parts = [e["name"] == k] if k else []
        if wanted:
            parts.append(F.exists(e["value_text"], lambda t: F.arrays_overlap(F.regexp_extract_all(F.lower(t), F.lit(r"(\w+)")), F.array(*map(F.lit, wanted)))))
        return _all(parts)

    return _null_safe(F.exists(entries, fits))


def metadata_plugins(assets: DataFrame, column: str = "vlm") -> list[str]:
    """The plugins that have metadata; a filter on metadata is an error without any."""
    return sorted(r[0] for r in assets.select(F.explode(F.map_keys(column))).distinct().collect())


def dimension_range(dimension: Column, least: float | None = None, most: float | None = None) -> Column:
    """Both ends inclusive."""
    return _null_safe(_all(([dimension >= least] if least is not None else []) + ([dimension <= most] if most is not None else [])))


def url_whitelist(assets: DataFrame, urls: DataFrame, key: str = "base_key") -> DataFrame:
    """P16; urls(url). An empty list keeps nothing."""
    return assets.join(urls.select(F.col("url").alias(key)), key, "left_semi")


def views_keyword(views: Column, must: list[str] = (), must_not: list[str] = ()) -> Column:
    """Some view has each keyword of must; no view has any of must_not."""
    has = lambda k: F.exists(views, lambda v: F.array_contains(v["keyword"], k))
    return _null_safe(F.size(views) > 0) & _all([_null_safe(has(k)) for k in must]) & _all([~_null_safe(has(k)) for k in must_not])


def key_filter(key: Column, value: str, mode: str = "prefix") -> Column:
    """P18."""
    return {"prefix": key.startswith, "contains": key.contains, "suffix": key.endswith, "regexp": lambda v: url_regexp(key, v)}[mode](value)


def under_path(prefixes: Column, path: str) -> Column:
    """P19, on path_prefixes()."""
    return F.array_contains(prefixes, "/" + path.strip("/"))


def filter_only(assets: DataFrame, condition: Column, key: str = "base_key") -> DataFrame:
    """P20: rows that pass, each of score 1, ranked by key. Ranks are counted over ranges of the key, so no task holds all rows."""
    rows = assets.filter(condition).withColumn("score", F.lit(1.0))
    return global_rank(rows, key)


def global_rank(rows: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """1-based position by `order` without a single-task window: ranges are counted, then numbered within."""
    from pyspark.sql import Window

    from orrery.sources.tables import written

    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition: a bounded window
    before = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_at", "_before")


# Structured filters and the registry of fields

REGISTRY_SCHEMA = "field string, kind string, param string, after_param string, before_param string, property string, operators array<string>"

# The fields that a parsed filter may name.
FIELDS = [
    ("name", "wildcard", "file_name", None, None, None, ["=", "~"]),
    ("extension", "wildcard", "file_extension_include", None, None, None, ["="]),
    ("created", "date", None, "created_after", "created_before", None, [">=", "<="]),
    ("modified", "date", None, "modified_after", "modified_before", None, [">=", "<="]),
    ("size", "size", None, "file_size_greater_than", "file_size_less_than", None, [">=", "<="]),
    ("author", "equality", "created_by", None, None, None, ["="]),
    ("brand", "property", "filter_by_properties", None, None, "brand", ["=", "~"]),
    ("weight", "numeric", "filter_by_properties_numeric", None, None, "weight", [">=", "<=", ">", "<", "="]),
]
#: Parameters whose fragments are joined by commas; of others the last one wins.
MERGEABLE = ["file_name", "file_extension_include", "filter_by_properties", "filter_by_properties_numeric"]


def field_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, REGISTRY_SCHEMA)


def map_filters(parsed: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P21. parsed(query_id, pos, field, operator, value) to (query_id, param, value) and the filters with reason (null: applied)."""
    r = parsed.join(registry, "field", "left")
    value, op = F.col("value"), F.col("operator")
    reason = (
        F.when(F.col("kind").isNull(), "unknown field")
        .when(~F.array_contains("operators", op), "unsupported operator")
        .when(value.isNull() | (F.trim(value) == ""), "empty value")
        .when((F.col("kind") == "date") & ~value.rlike(r"^(\d{4}-\d{2}-\d{2}([T ].*)?|\d{8})$"), "malformed date")
        .when((F.col("kind") == "size") & ~value.rlike(r"^\d+[KMGT]B$"), "malformed size")
        .when((F.col("kind") == "numeric") & value.try_cast("double").isNull(), "malformed number")
    )
    param = F.when(F.col("kind").isin("date", "size"), F.when(op == ">=", F.col("after_param")).otherwise(F.col("before_param"))).otherwise(F.col("param"))
    fragment = F.when(F.col("kind") == "property", F.concat("property", F.when(op == "~", F.lit("=~")).otherwise(F.lit("=")), "value")).when(F.col("kind") == "numeric", F.concat("property", "operator", "value")).otherwise(value)
    judged = r.select("query_id", "pos", "field", "operator", "value", reason.alias("reason"), param.alias("param"), fragment.alias("fragment"))
    grouped = judged.filter("reason is null").groupBy("query_id", "param").agg(F.array_sort(F.collect_list(F.struct("pos", "fragment"))).alias("f"))
    merged = F.when(F.col("param").isin(MERGEABLE), F.array_join(F.col("f.fragment"), ",")).otherwise(F.element_at("f.fragment", -1))
    return grouped.select("query_id", "param", merged.alias("value")), judged.select("query_id", "pos", "field", "operator", "value", "reason")
