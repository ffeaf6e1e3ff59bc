"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero: norms are held above 1e-12."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def pair_features(a: Column, b: Column) -> Column:
    """|a - b| and a * b in one vector."""
    return F.concat(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def bits(v: Column, threshold: float = 0.0, width: int = 32) -> Column:
    """Sign bits packed into words of `width` bits."""
    one = F.transform(v, lambda x: F.when(x > threshold, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    starts = F.sequence(F.lit(1), F.size(v), F.lit(width))
    return F.transform(starts, lambda s: F.aggregate(F.slice(one, s, F.lit(width)), F.lit(0).cast("bigint"), lambda acc, x: acc * 2 + x))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def mips_extended(v: Column, top_norm2: Column) -> Column:
    """A further coordinate that turns inner-product search into Euclidean search (V7)."""
    return F.concat(v, F.array(F.sqrt(F.greatest(top_norm2 - dot(v, v), F.lit(0.0)))))


def sparse_top(v: Column, k: int) -> Column:
    """(index, weight) of the k largest positive weights, ties by index."""
    entries = F.filter(F.transform(v, lambda x, i: F.struct((-x).alias("neg"), i.cast("bigint").alias("index"))), lambda e: e["neg"] < 0)
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["index"].alias("index"), (-e["neg"]).alias("weight")))


#: Score functions by name (U3). All are larger for closer vectors.
SCORES = {"cos_sim": cosine, "dot": dot, "euclidean": lambda a, b: -euclidean(a, b), "manhattan": lambda a, b: -manhattan(a, b)}
