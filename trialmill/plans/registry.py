"""Named queries over the bundled tables, each with the SQL another engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def add(name: str, build: Builder, sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name} is registered twice")
    REGISTRY[name] = Query(build, sql)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round the double columns, for sums whose last bits depend on the order of addition."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def load_all() -> dict[str, Query]:
    from . import q_corpus, q_io, q_ledger, q_metrics, q_routing, q_stats, q_text  # noqa: F401

    return REGISTRY
