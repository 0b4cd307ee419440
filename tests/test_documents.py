"""Deep merge and flattening against plain dictionaries."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions.documents import deep_merge, document_changes, flatten_document
from orrery.sources import tables as T


def merge(a, b):
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return copy.deepcopy(b)
    return {**a, **{k: merge(a[k], v) if k in a else copy.deepcopy(v) for k, v in b.items()}}


def flat(d, prefix=""):
    out = {}
    for k in sorted(d):
        out |= flat(d[k], f"{prefix}{k}__") if isinstance(d[k], dict) else {prefix + k: d[k]}
    return out


def document(rng, depth):
    if depth and rng.random() < 0.75:
        return {rng.choice(["a", "b", "c", "d e", "ü"]): document(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return rng.choice([None, True, False, 0, -7, 2**40, 1.5, "", "x y", "null", [], [1, [2, {"k": 1}]], ["s", None]])


def documents(n, depth, seed=0):
    rng = random.Random(seed)
    return [({k: document(rng, depth) for k in "abc"}, {k: document(rng, depth) for k in rng.sample("abcd", 2)}) for _ in range(n)]


def frame(spark, pairs):
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    return df.select("i", F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))


def test_random_documents(spark):
    pairs = documents(300, 4) + [({"a": 1}, {"a": {}}), ({"a": {"b": 1}}, {"a": {}}), ({"a": {"b": 1}}, {"a": None}), ({}, {}), ({"a": None}, {"a": {"b": {"c": None}}})]
    df = frame(spark, pairs)
    got = {r.i: r for r in df.select("i", F.to_json(deep_merge(F.col("a"), F.col("b"))).alias("m"), F.to_json(flatten_document(F.col("a"))).alias("f"), document_changes(F.col("a"), F.col("b")).alias("c")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert json.loads(got[i].m) == merge(a, b)
        assert json.loads(got[i].f) == flat(a)
        old, new = flat(a), flat(merge(a, b))
        keys = sorted((k for k in old.keys() | new.keys() if k not in old or k not in new or json.dumps(old[k]) != json.dumps(new[k])), key=lambda k: k.encode())
        told = [(c.key, c.old and json.loads(c.old), c.new and json.loads(c.new)) for c in got[i].c]
        assert told == [(k, old.get(k), new.get(k)) for k in keys]


def test_paths_that_give_one_key(spark):
    df = frame(spark, [({"a__b": 1, "a": {"b": 2, "c": 3}}, {}), ([1], {}), (5, {})])
    got = [r.f for r in df.orderBy("i").select(F.to_json(flatten_document(F.col("a"))).alias("f")).collect()]
    assert json.loads(got[0]) == {"a__b": 1, "a__c": 3} and got[1:] == [None, None]


def test_depth(spark):
    deep = lambda n, leaf: {"k": deep(n - 1, leaf)} if n else leaf
    df = frame(spark, [(deep(9, 1), deep(9, 2))])
    assert json.loads(df.select(F.to_json(deep_merge(F.col("a"), F.col("b"))).alias("m")).first().m) == deep(9, 2)
    with pytest.raises(Exception, match="more than 4 levels"):
        df.select(F.to_json(deep_merge(F.col("a"), F.col("b"), 4))).collect()
    with pytest.raises(Exception, match="more than 4 levels"):
        df.select(F.to_json(flatten_document(F.col("a"), depth=4))).collect()


@pytest.mark.parametrize("kind", ["string", "variant", "map"])
def test_updates_of_new_keys_are_inserted(spark, kind):
    old = [(1, {"a": {"x": "1", "y": "2"}}, "kept"), (2, {"b": {"z": "3"}}, "kept"), (3, None, "kept")]
    new = [(1, {"a": {"y": "9"}, "c": {"q": "4"}}), (3, {"n": {"m": "5"}}), (4, {"a": {"x": "6"}}), (5, None)]
    ddl = "map<string,map<string,string>>" if kind == "map" else "string"
    value = (lambda d: d) if kind == "map" else (lambda d: None if d is None else json.dumps(d))
    t = spark.createDataFrame([(k, value(d), m) for k, d, m in old], f"k long, d {ddl}, meta string")
    u = spark.createDataFrame([(k, value(d)) for k, d in new], f"k long, d {ddl}")
    if kind == "variant":
        t, u = (x.withColumn("d", F.parse_json("d")) for x in (t, u))
    out = T.merge_nested(t, u, "k", "d")
    assert out.columns == ["k", "d", "meta"] and out.schema["d"].dataType.simpleString() == t.schema["d"].dataType.simpleString()
    rows = {r.k: (r.d if kind == "map" else r.d and json.loads(r.d), r.meta) for r in (out if kind == "map" else out.withColumn("d", F.to_json("d") if kind == "variant" else F.col("d"))).collect()}
    want = {1: ({"a": {"x": "1", "y": "9"}, "c": {"q": "4"}}, "kept"), 2: ({"b": {"z": "3"}}, "kept"), 3: ({"n": {"m": "5"}}, "kept"), 4: ({"a": {"x": "6"}}, None), 5: ({} if kind == "map" else None, None)}
    assert rows == want
