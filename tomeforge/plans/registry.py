"""All core queries and their SQL, by name."""

from __future__ import annotations

from tomeforge.plans import incremental, pipeline, retrieval, texts

MODULES = [incremental, texts, retrieval, pipeline]


def core_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def core_oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
