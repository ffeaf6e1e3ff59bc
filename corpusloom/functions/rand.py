"""Deterministic uniforms: the same draw for the same seed, id and position on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A double in [0, 1) from the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def below(seed: int, n: Column, *parts: Column) -> Column:
    """An integer in [0, n)."""
    return F.floor(uniform(seed, *parts) * n).cast("bigint")


def sql_uniform(seed: int, *parts: str) -> str:
    """The same draw in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'({p})::varchar' for p in parts)})), 1, 8))::ubigint / 4294967296.0)"
