"""Registry of queries. A query takes (session, folder with the tables) and returns a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, build, sql)
        return build

    return register
