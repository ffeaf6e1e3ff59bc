"""JSON and map handling, further vector math, learning-rate schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_field(text: Column, schema: str, path: str) -> Column:
    """A field of a JSON line, null where the line is not such an object."""
    out = F.from_json(text, schema)
    for name in path.split("."):
        out = out[name]
    return out


def map_updated(m: Column, more: Column) -> Column:
    """m with the entries of more; equal keys take more's value."""
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(more, k)), more)


def map_without(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def log1p_relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.ln(1.0 + F.greatest(x, F.lit(0.0))))


def log_sum_exp(v: Column) -> Column:
    """Stable: the maximum is taken out first."""
    top = F.array_max(v)
    return top + F.ln(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def sign(v: Column) -> Column:
    return F.transform(v, lambda x: F.signum(x))


def tanh_scaled(v: Column, beta: float) -> Column:
    return F.transform(v, lambda x: F.tanh(x * beta))


def unpack_bits(words: Column, dims: int, width: int = 32) -> Column:
    """Packed words (vector.bits) as +1 and -1."""

    def one(i: Column) -> Column:
        word = F.get(words, F.floor(i / width).cast("int"))
        place = F.least(F.lit(width), F.lit(dims) - F.floor(i / width) * width) - 1 - i % width
        return F.when(F.floor(word / F.pow(F.lit(2.0), place)) % 2 == 1, 1.0).otherwise(-1.0)

    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), one)


def linear_schedule(step: Column, warmup: int, total: int) -> Column:
    """Factor of the base rate: up over the warm-up, then down to 0."""
    down = F.greatest(F.lit(0.0), (total - step) / float(max(1, total - warmup)))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(down)


def cosine_schedule(step: Column, warmup: int, total: int, cycles: int = 1, decay: float = 1.0) -> Column:
    """Cosine with hard restarts, each cycle's peak multiplied by decay."""
    progress = (step - warmup) / float(max(1, total - warmup))
    cycle = F.floor(progress * cycles)
    wave = 0.5 * (1.0 + F.cos(math.pi * ((progress * cycles) % 1.0)))
    late = F.when(progress >= 1.0, 0.0).otherwise(F.pow(F.lit(decay), cycle) * wave)
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(late)
