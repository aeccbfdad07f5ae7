"""Queries of the training-data operators."""

from __future__ import annotations

import importlib

from quarryglass.catalog import Catalog

CATALOG = Catalog()
MODULES = ("linkage_queries", "survivor_queries", "cooccurrence_queries", "text_queries")

for _m in MODULES:
    importlib.import_module(f"quarryglass.llm.{_m}").register(CATALOG)
