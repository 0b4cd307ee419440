"""Scalar, string, array, map and date functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FLT_MAX = 3.4028234663852886e38
#: The scale and bias by which a cosine becomes a match probability.
MATCH_SCALE, MATCH_BIAS = 108.33, -15.98


def wildcard_regex(pattern: str, ignore_case: bool = True) -> str:
    """* and ? anchored over the whole string."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?{'i' if ignore_case else ''}s)^{body}$"


def keyword_tokens(c: Column) -> Column:
    """F2, keyword: the whole value."""
    return F.when(c.isNotNull(), F.array(c))


def standard_tokens(c: Column) -> Column:
    """F2, standard: runs of letters, digits and _, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"))


def simple_tokens(c: Column) -> Column:
    """F2, simple: runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"))


def whitespace_tokens(c: Column) -> Column:
    """F2, whitespace."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def _parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda x: x != "")


def path_prefixes(c: Column) -> Column:
    """/a, /a/b, /a/b/c."""
    parts = _parts(c)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))


def path_suffixes(c: Column) -> Column:
    """F3, reversed: a/b/c, b/c, c."""
    parts = _parts(c)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """F4; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(2.0))


def half_cosine_distance(a: Column, b: Column) -> Column:
    """F6."""
    return cosine_distance(a, b) / 2


def match_probability(cosine: Column) -> Column:
    """F7."""
    return 1 / (1 + F.exp(-(F.lit(MATCH_SCALE) * cosine + F.lit(MATCH_BIAS))))


def softmax(a: Column) -> Column:
    """F8, shifted by the maximum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def normalize_url(base: Column, ref: Column) -> Column:
    """resolve ref against the folder of base; backslashes, . and .. are resolved; absolute URLs stay as they are."""
    ref = F.replace(ref, F.lit("\\"), F.lit("/"))
    base = F.replace(base, F.lit("\\"), F.lit("/"))
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*|)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"[^/]*$", "")
    path = F.when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))
    query = F.regexp_extract(path, r"(\?.*)$", 1)
    steps = F.split(F.regexp_replace(path, r"\?.*$", ""), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda s, x: F.when((x == "") | (x == "."), s).when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref).otherwise(F.concat(root, F.lit("/"), F.array_join(kept, "/"), query))


def basename(c: Column) -> Column:
    """F10."""
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    """after the last dot of the base name, in lower case; empty without one."""
    return F.lower(F.regexp_extract(basename(c), r"\.([^.]*)$", 1))


def dirname(c: Column) -> Column:
    """F10."""
    return F.regexp_replace(c, r"/[^/]*$", "")


def size_bytes(c: Column) -> Column:
    """10MB is 10 * 1024^2; null if malformed."""
    unit = F.create_map(*(F.lit(x) for pair in (("K", 1024), ("M", 1024**2), ("G", 1024**3), ("T", 1024**4)) for x in pair))
    return F.when(c.rlike(r"^\d+[KMGT]B$"), F.regexp_extract(c, r"^(\d+)", 1).cast("long") * F.element_at(unit, F.regexp_extract(c, r"([KMGT])B$", 1)))


def percentage(part: Column, whole: Column, eps: float = 1e-9) -> Column:
    """F12."""
    return 100.0 * part / F.greatest(whole.cast("double"), F.lit(eps))


def percentage_string(part: Column, whole: Column) -> Column:
    """with two digits; null if either is."""
    p = percentage(part, whole)
    return F.when(p.isNotNull(), F.format_string("%.2f%%", p))


BOOLEAN_TOKENS = ["true", "false", "yes", "no", "0", "1"]


def infer_value_type(values: Column) -> Column:
    """F13, an aggregate: boolean if all values are boolean tokens, number if at least 95 % parse, else string; string without values."""
    known = F.lower(values)
    return (
        F.when(F.count(values) == 0, "string")
        .when(F.bool_and(known.isin(BOOLEAN_TOKENS)), "boolean")
        .when(F.avg(F.when(values.isNotNull(), values.try_cast("double").isNotNull().cast("int"))) >= 0.95, "number")
        .otherwise("string")
    )


def detect_numeric(c: Column) -> Column:
    """a double if c is a finite number in plain or scientific notation, else null."""
    d = F.when(c.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(c).try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def numeric_type(c: Column) -> Column:
    """int if canonical, float for other numbers, else str."""
    return F.when(c.rlike(r"^-?(0|[1-9]\d*)$"), "int").when(detect_numeric(c).isNotNull(), "float").otherwise("str")


def format_property(name: Column, value: Column) -> Column:
    """struct of name, value, value_type and value_numeric (null unless a number)."""
    return F.struct(name.alias("name"), value.alias("value"), numeric_type(value).alias("value_type"), detect_numeric(value).alias("value_numeric"))


def clamp(c: Column) -> Column:
    """F16: into the range of a float."""
    return F.greatest(F.lit(-FLT_MAX), F.least(F.lit(FLT_MAX), c))


def semantic_label_cleanup(properties: Column, prefix: str = "semantic:Semantics_", into: str = "semantic_labels") -> Column:
    """keys with the prefix become one JSON value (keys in order)."""
    found = F.map_filter(properties, lambda k, v: k.startswith(prefix))
    rest = F.map_filter(properties, lambda k, v: ~k.startswith(prefix))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(found)))
    return F.when(F.size(found) > 0, F.map_concat(rest, F.map_from_arrays(F.array(F.lit(into)), F.array(F.to_json(ordered))))).otherwise(properties)


def flatten_keys(outer: Column) -> Column:
    """map<string, map<string, string>> to a__b keys."""
    return F.map_from_entries(F.flatten(F.transform(F.map_entries(outer), lambda e: F.transform(F.map_entries(e["value"]), lambda i: F.struct(F.concat(e["key"], F.lit("__"), i["key"]).alias("key"), i["value"].alias("value"))))))


def slug(c: Column) -> Column:
    """camelCase split, everything else to _, collapsed, lower case."""
    split = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def parse_label_string(c: Column) -> Column:
    """"tag (95%), other" to structs of tag and prob (1 by default)."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    percent = lambda x: F.regexp_extract(x, r"\((\d+(?:\.\d+)?)%\)\s*$", 1)
    return F.transform(items, lambda x: F.struct(F.trim(F.regexp_replace(x, r"\(\d+(?:\.\d+)?%\)\s*$", "")).alias("tag"), F.when(percent(x) != "", percent(x).cast("double") / 100).otherwise(1.0).alias("prob")))


def columns_to_rows(**columns: Column) -> Column:
    """arrays side by side to an array of structs."""
    return F.arrays_zip(*(c.alias(n) for n, c in columns.items()))


def rows_to_columns(rows: Column, field: str) -> Column:
    """F22, backwards: one field of an array of structs."""
    return F.transform(rows, lambda r: r[field])


def combine_strings(a: Column, b: Column) -> Column:
    """joined by comma and blank, nulls left out."""
    return F.concat_ws(", ", a, b)


def combine_lists(a: Column, b: Column) -> Column:
    """appended."""
    return F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def combine_maps(a: Column, b: Column) -> Column:
    """strings of both maps by key; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: combine_strings(x, y))


def date_from_timestamp(seconds: Column) -> Column:
    """seconds since the epoch as text with milliseconds."""
    return F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")


def date_to_timestamp(text: Column) -> Column:
    """F24, backwards."""
    return F.unix_millis(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss.SSS")) / 1000.0


def content_hash(c: Column) -> Column:
    """F25."""
    return F.sha2(c, 256)


def archive_path(url: Column, common: Column) -> Column:
    """without the scheme and the common folder; .. is neutralised."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    base = F.regexp_replace(common, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    inside = F.when(bare.startswith(base), F.substr(bare, F.length(base) + 1)).otherwise(bare)
    return F.array_join(F.transform(_parts(inside), lambda x: F.when(x == "..", "_").otherwise(x)), "/")


def metadata_rows(fields: Column) -> Column:
    """JSON object of fields to {name, value_text[], value_bool}: comma strings are split; objects and nulls are dropped."""
    entries = F.map_entries(F.from_json(fields, "map<string,string>"))
    row = lambda e: F.struct(e["key"].alias("name"), F.when(e["value"].isin("true", "false"), F.array().cast("array<string>")).when(e["value"].startswith("["), F.from_json(e["value"], "array<string>")).otherwise(F.transform(F.split(e["value"], ","), lambda x: F.trim(x))).alias("value_text"), F.when(e["value"].isin("true", "false"), e["value"] == "true").alias("value_bool"))
    return F.transform(F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].startswith("{")), row)


def quoted_list(c: Column) -> Column:
    """comma list whose items may be quoted with " or '."""
    items = F.regexp_extract_all(c, F.lit(r"""((?:[^,"']|"[^"]*"|'[^']*')+)"""), F.lit(1))
    return F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"""["']""", ""))), lambda x: x != "")


def parse_quoted_list(text: str) -> list[str]:
    """F28 for a single request."""
    items = re.findall(r"""(?:[^,"']|"[^"]*"|'[^']*')+""", text)
    return [v for x in items if (v := re.sub(r"""["']""", "", x).strip())]


def tags_in(tags: Column, namespace: str, kind: str = "user") -> Column:
    """the tags of a namespace: user, generated (.ns.generated) or excluded (.ns.excluded)."""
    name = {"user": namespace, "generated": f".{namespace}.generated", "excluded": f".{namespace}.excluded"}[kind]
    return F.filter(tags, lambda t: t["namespace"] == name)


def valid_date(c: Column) -> Column:
    """ISO date or datetime, or YYYYMMDD."""
    return F.coalesce(c.rlike(r"^(\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?|\d{8})$"), F.lit(False))


def valid_size(c: Column) -> Column:
    """F30."""
    return F.coalesce(c.rlike(r"^\d+[KMGT]B$"), F.lit(False))
