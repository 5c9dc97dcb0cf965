"""Queries by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from curbside.plans.oracle import with_stages
from curbside.stages import TicketStages

Build = Callable[[TicketStages], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str


REGISTRY: dict[str, Query] = {}


def query(sql: str, on: str) -> Callable[[Build], Build]:
    """Register a function under its own name.

    ``sql`` computes the same rows with DuckDB, from the stage named by ``on``.
    """

    def register(build: Build) -> Build:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"two queries are called {name}")
        REGISTRY[name] = Query(name, build, with_stages(on, sql))
        return build

    return register
