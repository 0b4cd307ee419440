"""All registered queries of the search and scene-graph engine."""

from __future__ import annotations

from importlib import import_module

from . import base

MODULES = ["predicates", "retrieval", "scene", "statistics", "ingestion", "indexing"]

for _m in MODULES:
    import_module(f"orrery.plans.{_m}")


def flagship(spark, sf_dir: str):
    return import_module("orrery.plans.retrieval").flagship(spark, sf_dir)


def queries() -> dict:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.SQL
