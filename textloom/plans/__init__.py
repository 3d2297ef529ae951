"""Queries over the driver's tables: by name, the DataFrame builder and the same in SQL (None where SQL has no form)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.bindings import Tables

FAMILIES = ("classification", "authorship", "agreement", "evolution", "text", "conformity", "networks", "views", "standards", "relations", "histories", "composed", "shapes")


def _all() -> dict[str, tuple]:
    return {name: q for family in FAMILIES for name, q in import_module(f"textloom.plans.{family}").QUERIES.items()}


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bind(build) for name, (build, _) in _all().items()}


def library_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
