"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

from corpusloom.shipping import shipped

#: Module of each registered query, in order.
_MODULES = ("chat", "token_count", "embedding_dup", "warc", "language_id", "license_scan", "decontaminate", "secrets", "near_dup", "packing")


def _loaded():
    return [importlib.import_module(f"corpusloom.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {m.NAME: shipped(m.query) for m in _loaded()}


def oracle_sql() -> dict:
    return {m.NAME: m.SQL for m in _loaded() if getattr(m, "SQL", None)}
