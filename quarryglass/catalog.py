"""A query of the catalogue: how Spark runs it over the tables of a folder, and equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    runs: dict[str, Run] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        """Register the decorated function under ``name``."""

        def add(run: Run) -> Run:
            if name in self.runs:
                raise ValueError(f"{name} is registered twice")
            self.runs[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return add
