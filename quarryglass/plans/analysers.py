"""Analysers as functions of DataFrames, and a registry that picks one by priority."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Analyser(Protocol):
    """Adds the columns of an analysis to rows with a path or content."""

    def analyse(self, files: DataFrame) -> DataFrame: ...


@dataclass
class BatchAnalyser:
    """An analyser around a model: ``load`` is called once in each task, ``detect`` on each Arrow batch.

    ``detect(model, batch)`` returns a frame of ``schema``. A batch on which it raises comes out with nulls and the message
    in ``error`` where the schema has that column, else the task fails.
    """

    schema: str
    load: Callable[[], object]
    detect: Callable[[object, pd.DataFrame], pd.DataFrame]
    key: str = "path"

    def analyse(self, files: DataFrame) -> DataFrame:
        load, detect, key = self.load, self.detect, self.key
        names = [f.strip().split(" ", 1)[0] for f in self.schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                try:
                    yield detect(model, batch)[names]
                except Exception as e:
                    if "error" not in names:
                        raise
                    yield pd.DataFrame({n: batch[key] if n == key else str(e) if n == "error" else None for n in names}, index=batch.index)

        return files.mapInPandas(run, self.schema)


@dataclass
class Registry:
    """Makers of analysers with a priority; the first one that is enabled and can be made is taken."""

    makers: dict[str, tuple[int, Callable[[], Analyser | None]]] = field(default_factory=dict)

    def add(self, name: str, priority: int, make: Callable[[], Analyser | None]) -> None:
        self.makers[name] = (priority, make)

    def pick(self, enabled: set[str] | None = None) -> Analyser | None:
        """By descending priority, then name; None where none is enabled. A maker that raises or gives None is passed over."""
        for name, (_, make) in sorted(self.makers.items(), key=lambda kv: (-kv[1][0], kv[0])):
            if enabled is not None and name not in enabled:
                continue
            try:
                made = make()
            except (ImportError, OSError, RuntimeError):
                continue
            if made is not None:
                return made
        return None
