"""All queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and, where SQL can express one, ORACLES.
MODULES = ["tokens", "packing", "rankwalk", "confusables", "neardup", "language", "scans", "names", "privacy"]


def _loaded() -> list:
    return [import_module(f"tomeforge.llm.{m}") for m in MODULES]


def llm_queries() -> dict:
    return {k: v for m in _loaded() for k, v in m.QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    return {k: v for m in _loaded() for k, v in getattr(m, "ORACLES", {}).items()}
