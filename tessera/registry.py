"""The registry of queries outside ``llm``: name to (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.cube import load_cube
from tessera.plans.prelude import sql

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered twice")
    REGISTRY[name] = (run, oracle)


def on_cube(name: str, run: Callable, select: str | None, *marts: str) -> None:
    """Register a query that takes the cube; ``select`` is its SQL over the cube's relations and ``marts``."""
    add(name, lambda spark, sf_dir: run(load_cube(spark, sf_dir)), select and sql(select, *marts))


def on_tables(name: str, run: Callable[..., DataFrame], tables: str, select: str | None) -> None:
    """Register a query that takes the tables named, as frames."""
    add(name, lambda spark, sf_dir: run(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split())), select)
