"""Queries of the subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("syntax", "splitting", "grouping", "layout", "secrets", "tokens", "mixing", "quality")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    try:
        _module = import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as error:
        if error.name != f"{__package__}.{_name}":
            raise
        continue
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
