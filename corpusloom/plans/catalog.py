"""All registered queries of the library proper, and their SQL twins."""

from __future__ import annotations

from corpusloom.shipping import shipped

FLAGSHIP = "V1_dense_top10_metrics"


def _modules():
    from . import data, dense, io, more, texts

    return dense, texts, data, io, more


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        out |= {name: shipped(fn) for name, fn in module.QUERIES.items()}
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for module in _modules():
        out |= module.SQL
    return out
