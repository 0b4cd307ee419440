"""User functions: producers, embeddings, judges and extractors over Arrow batches. Failed rows become rows with an error."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The producers, the extensions they take, and whether they need a rendering.
PLUGINS = [
    ("image_to_embedding", ["png", "jpg", "jpeg"], True, False),
    ("thumbnail_to_embedding", ["usd", "usda", "usdc", "usdz"], True, False),
    ("image_to_vision_metadata", ["png", "jpg", "jpeg"], True, False),
    ("rendering_to_vision_metadata", ["usd", "usda", "usdc", "usdz"], True, True),
    ("thumbnail_to_vision_metadata", ["usd", "usda", "usdc", "usdz"], True, False),
    ("rendering_to_embedding", ["usd", "usda", "usdc", "usdz"], True, True),
    ("thumbnail_generation", ["usd", "usda", "usdc", "usdz"], True, True),
    ("asset_graph_generation", ["usd", "usda", "usdc", "usdz"], True, False),
]


def plugin_registry(spark: SparkSession) -> DataFrame:
    """E2."""
    return spark.createDataFrame(PLUGINS, "name string, data_types array<string>, active boolean, render boolean")


class Producer:
    """Override what is needed; process gets the valid items of a batch and returns a result for each."""

    name = "producer"

    def should_process(self, items: pd.DataFrame) -> pd.Series:
        return pd.Series(True, index=items.index)

    def preprocess(self, items: pd.DataFrame) -> tuple[pd.DataFrame, dict[int, str]]:
        """Valid items and, by index, why others aren't."""
        return items, {}

    def process(self, items: pd.DataFrame) -> list[str | None]:
        raise NotImplementedError


def run_producer(items: DataFrame, producer: Producer, key: str = "uri") -> DataFrame:
    """(key, plugin, status, content, error) for every item: skipped, failed or processed. Counts that don't match fail the batch's items, not the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            out = pd.DataFrame({key: pdf[key], "plugin": producer.name, "status": "skipped", "content": None, "error": None})
            todo = pdf[producer.should_process(pdf)]
            try:
                valid, errors = producer.preprocess(todo)
                for i, e in errors.items():
                    out.loc[i, ["status", "error"]] = ["failed", e]
                results = producer.process(valid) if len(valid) else []
                if len(results) != len(valid):
                    raise ValueError(f"{len(valid)} items gave {len(results)} results")
                out.loc[valid.index, "status"] = "processed"
                out.loc[valid.index, "content"] = pd.Series(results, index=valid.index, dtype=object)
            except Exception as e:  # noqa: BLE001  a producer is foreign code: its error belongs to the rows
                rest = out.index[out["status"].eq("skipped") & out.index.isin(todo.index)]
                out.loc[rest, ["status", "error"]] = ["failed", f"{type(e).__name__}: {e}"]
            yield out

    kind = dict(items.dtypes)[key]
    return items.mapInPandas(run, f"{key} {kind}, plugin string, status string, content string, error string")


def embed(items: DataFrame, function: Callable[[list], list[list[float]]], column: str, id_col: str = "asset_id") -> DataFrame:
    """items(id, column: array of inputs): inputs of many assets are embedded together, then put back in their order."""

    @F.pandas_udf("array<float>")
    def vectors(inputs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in inputs:
            yield pd.Series(function(s.tolist()))

    each = items.select(id_col, F.posexplode(column).alias("offset", "input")).withColumn("vector", vectors("input"))
    return each.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "vector"))), lambda x: x["vector"]).alias("embeddings"))


def judge(pool: DataFrame, function: Callable[[str, str], dict], query: str = "query", item: str = "item") -> DataFrame:
    """is_match, confidence, score and reasoning for each pair; nulls where the function fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, i in zip(pdf[query], pdf[item]):
                try:
                    v = function(q, i)
                    rows.append((v["is_match"], v["confidence"], v["score"], v["reasoning"]))
                except Exception:  # noqa: BLE001  a judge is foreign code: a failed verdict is null
                    rows.append((None, None, None, None))
            verdicts = pd.DataFrame(rows, columns=["is_match", "confidence", "score", "reasoning"], index=pdf.index)
            yield pd.concat([pdf, verdicts], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in pool.dtypes)
    return pool.mapInPandas(run, f"{schema}, is_match boolean, confidence double, score double, reasoning string")


def extract_metadata(items: DataFrame, function: Callable[[object], dict], column: str, id_col: str = "asset_id") -> DataFrame:
    """E5: (id, status, fields as JSON, error); metadata_rows() makes typed rows of the fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, v in zip(pdf[id_col], pdf[column]):
                try:
                    out.append((k, "processed", json.dumps(function(v)), None))
                except Exception as e:  # noqa: BLE001  an extractor is foreign code: its error is the row's status
                    out.append((k, "failed", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[id_col, "status", "fields", "error"])

    kind = dict(items.dtypes)[id_col]
    return items.select(id_col, column).mapInPandas(run, f"{id_col} {kind}, status string, fields string, error string")
