"""All registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from folium.plans.fixtures import with_views

PARTS = ("fusion", "search", "state", "graph", "ingest", "streams")


def _all() -> dict[str, tuple[Callable, str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {}
    for part in PARTS:
        out |= import_module(f"folium.plans.{part}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _all().items() if sql}
