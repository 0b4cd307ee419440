"""Documents of any depth as VARIANT columns: deep merge, changes, flattening. All are JVM expressions over one row.

An expression is unrolled to a number of levels, each written once in the level above, so its size grows with the
depth that is allowed and its work with the document. Deeper documents are an error, never a wrong result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of objects within objects that expressions are unrolled to.
DEPTH = 12
_MAP = "map<string,variant>"


def _object(v: Column) -> Column:
    """An object's keys and values; null for anything else."""
    return F.try_variant_get(v, "$", _MAP)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value written and computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _too_deep(kind: str, depth: int) -> Column:
    return F.raise_error(F.lit(f"objects within objects over more than {depth} levels")).cast(kind)


def deep_merge(base: Column, update: Column, depth: int = DEPTH) -> Column:
    """Update over base: objects merge key by key at every level, and everything else (scalars, lists, JSON nulls) takes the place of what was there, be it an object. An object also takes the place of a scalar. A null row on one side leaves the other."""

    def merged(a: Column, b: Column, left: int) -> Column:
        x, y = _object(a), _object(b)
        inner = F.to_variant_object(F.map_zip_with(x, y, lambda k, m, n: F.when(n.isNull(), m).when(m.isNull(), n).otherwise(merged(m, n, left - 1)))) if left else _too_deep("variant", depth)
        return F.when(x.isNotNull() & y.isNotNull(), inner).otherwise(b)

    return F.when(update.isNull(), base).when(base.isNull(), update).otherwise(merged(base, update, depth))


def flatten_document(document: Column, separator: str = "__", depth: int = DEPTH) -> Column:
    """{"a": {"b": 1}} to {"a__b": 1} as map<string, variant>: lists stay whole, empty objects leave nothing; of paths that give one key the last in order of keys counts. Null for what is no object."""

    def entries(v: Column, prefix: Callable[[Column], Column], left: int) -> Column:
        def each(e: Column) -> Column:
            here = prefix(e["key"])
            deeper = entries(e["value"], lambda k: F.concat(here, F.lit(separator), k), left - 1) if left else _too_deep("array<struct<key:string,value:variant>>", depth)
            return F.when(_object(e["value"]).isNotNull(), deeper).otherwise(F.array(F.struct(here.alias("key"), e["value"].alias("value"))))

        return F.flatten(F.transform(F.map_entries(_object(v)), each))

    def mapped(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda e: e["key"]))
        last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)["value"]))
        return F.when(F.size(keys) == F.size(found), F.map_from_entries(found)).otherwise(last)

    return _let(entries(document, lambda k: k, depth), mapped)


def document_changes(base: Column, update: Column, separator: str = "__", depth: int = DEPTH) -> Column:
    """What a merge changes: an array of (key, old, new), as JSON texts, of the flattened keys whose values differ, in order of keys. old or new is null where there is no such key."""
    none = F.create_map().cast("map<string,string>")
    flat = lambda v: F.coalesce(F.transform_values(flatten_document(v, separator, depth), lambda k, x: F.to_json(x)), none)
    pairs = F.map_zip_with(flat(base), flat(deep_merge(base, update, depth)), lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    changed = _let(F.map_entries(pairs), lambda p: F.filter(p, lambda e: ~e["value"]["old"].eqNullSafe(e["value"]["new"])))
    return F.array_sort(F.transform(changed, lambda e: F.struct(e["key"].alias("key"), e["value"]["old"].alias("old"), e["value"]["new"].alias("new"))))
