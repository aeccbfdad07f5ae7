"""The catalogue of the core's queries."""

from __future__ import annotations

import importlib

from quarryglass.catalog import Catalog

CATALOG = Catalog()
MODULES = ("places", "times", "duplicates", "derived", "library", "logs", "records", "workflow")

for _m in MODULES:
    importlib.import_module(f"{__name__}.{_m}").register(CATALOG)
