"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors u, v have cosine >= c exactly if |u - v|^2 <= 2 - 2c. All vectors are turned by
one random rotation and split into blocks of about BLOCK_DIMS dimensions; the block
distances add up to the whole one, so some block has |u_b - v_b|^2 within its share of the
budget 2 - 2c, shares in proportion to the blocks' dimensions. Each block is a range join
under its share, and each pair that some block finds is verified once: cosine of the
original vectors in double precision.

Where the vectors of a label don't fill one tile they are dealt to tiles by hash, and every
pair of tiles is one group of a task. There the range joins of all blocks run in memory,
as products of matrices whose size does not grow with the input; only vectors travel, once
per tile of their label, and neither cells nor candidates are ever written. A task returns
link counts and, for the components, one link per vector and component seen, not pairs.

Equal vectors of a label are one representative with a multiplicity, so a group of copies
costs one comparison.

Defined results: null, zero, non-finite vectors, vectors with null components and rows
with a null label are linked with nothing (n_links 0, own component, kept); equal rows are
one vector, counted once, and rows of one vec_id with different vectors or labels are
vectors of their own; a null vec_id has a null component and is not kept; vectors of
unequal length are never linked; labels may have any type that Spark groups by; every row
gives a row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .near_dup import components

NAME = "op3_embedding_near_dup"
COSINE = 0.93
BLOCK_DIMS = 8
#: Widens every block's radius a little, so rounding in single precision loses no pair; links are decided by the exact cosine.
SLACK = 1e-5
#: Vectors of a tile and their bytes; rows of one matrix product; pairs verified at once.
TILE, TILE_BYTES, CHUNK, VERIFIED = 2048, 16 << 20, 256, 1 << 14


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows of x at length 1 in double precision; NaN where a vector cannot be linked."""
    x = x.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_TURNS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """The same random rotation everywhere."""
    if dims not in _TURNS:
        q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
        _TURNS[dims] = q * np.sign(np.diag(r))
    return _TURNS[dims]


def blocks(dims: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dims, max(1, round(dims / BLOCK_DIMS)) + 1).astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _raw_kernel(kind: str):
    """The components as bytes of the given number type; null where a vector cannot be linked."""

    def run(batches):
        for part in common.slices(batches):
            vectors = part.column("embedding")
            size = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = vectors.flatten()
            empty = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(flat.is_null().to_numpy(zero_copy_only=False), out=empty[1:])
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            stop = np.cumsum(size)
            raws: list[bytes | None] = [None] * len(size)
            for n in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero((size == n) & (empty[stop] == empty[stop - size]))
                x = values[(stop[rows] - n)[:, None] + np.arange(n)]
                for k in np.flatnonzero(np.isfinite(_unit(x)).all(axis=1)).tolist():
                    raws[rows[k]] = x[k].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(raws, pa.binary())], ["vec_id", "label", "raw"])

    return run


class Tile:
    """The vectors of a tile: units, and for each block the turned coordinates with what makes a product a squared distance."""

    def __init__(self, raws: list[bytes], kind: str):
        self.units = _unit(np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1))
        turned = (self.units @ rotation(self.units.shape[1])).astype(np.float32)
        self.left, self.right = [], []
        for lo, hi in blocks(turned.shape[1]):
            x = turned[:, lo:hi]
            norm, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), np.float32)
            self.left.append(np.concatenate((x, norm, one), axis=1))
            self.right.append(np.ascontiguousarray(np.concatenate((-2 * x, one, norm), axis=1).T))


def candidates(a: Tile, b: Tile, rows: slice, cosine: float) -> np.ndarray:
    """Which of these rows of a meet which rows of b in some block."""
    dims = a.units.shape[1]
    found = None
    for k, (lo, hi) in enumerate(blocks(dims)):
        budget = np.float32((np.sqrt((2 - 2 * cosine) * (hi - lo) / dims) + SLACK) ** 2)
        near = a.left[k][rows] @ b.right[k] <= budget
        found = near if found is None else np.logical_or(found, near, out=found)
    return found


def _join_kernel(cosine: float, kind: str):
    """Of two tiles: for every vector the multiplicity it links with, and links that connect what they connect."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("tile").to_numpy()
        same = side.min() == side.max()
        order = np.argsort(side, kind="stable")
        node, many = table.column("node").to_numpy()[order], table.column("many").to_numpy()[order]
        raws = table.column("raw").to_pylist()
        raws = [raws[k] for k in order.tolist()]
        cut = len(raws) if same else int((side == side.min()).sum())
        a = Tile(raws[:cut], kind)
        b, base = (a, 0) if same else (Tile(raws[cut:], kind), cut)
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, cut, CHUNK):
            met = candidates(a, b, slice(at, at + CHUNK), cosine)
            if same:
                met &= np.arange(at, min(cut, at + CHUNK))[:, None] < np.arange(len(node))[None, :]
            i, j = np.nonzero(met)
            i += at
            for k in range(0, len(i), VERIFIED):
                x, y = i[k : k + VERIFIED], j[k : k + VERIFIED]
                ok = np.einsum("ij,ij->i", a.units[x], b.units[y]) >= cosine
                x, y = x[ok], y[ok] + base
                links += np.bincount(x, many[y], len(node)).astype(np.int64) + np.bincount(y, many[x], len(node)).astype(np.int64)
                _unite(root, x, y)
        counted, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(node)))
        none = pa.nulls(len(counted), pa.int64())
        return pa.concat_tables(
            [
                pa.table({"a": pa.array(node[counted]), "b": none, "links": pa.array(links[counted])}),
                pa.table({"a": pa.array(node[joined]), "b": pa.array(node[root[joined]]), "links": pa.array(np.zeros(len(joined), np.int64))}),
            ]
        )

    return run


def _unite(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the sets of x and y, pair by pair; root holds each member's smallest known one."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    kind = "<f8" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "<f4"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    raws = rows.mapInArrow(_raw_kernel(kind), f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, raw binary")
    raws = common.materialize(raws.withColumn("key", F.sha2("raw", 256)), "emb-raw")
    able = raws.where("raw is not null and label is not null and vec_id is not null")
    repeated = not able.groupBy("vec_id").count().where("count > 1").isEmpty()
    many = F.count_distinct("vec_id") if repeated else F.count("*")
    reps = able.groupBy("label", "key").agg(F.min("vec_id").alias("first"), many.alias("many"), F.min("raw").alias("raw"))
    reps = common.materialize(reps.select(F.monotonically_increasing_id().alias("node"), "*", F.octet_length("raw").alias("size")), "emb-nodes")

    at = ["label", "size"]
    tiles = reps.groupBy(*at).agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.col("size").cast("bigint")) / TILE_BYTES)).cast("int").alias("tiles"))
    dealt = reps.join(tiles, at).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*at, F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "node", "many", "raw")
    found = common.materialize(dealt.groupBy(*at, "t1", "t2").applyInArrow(_join_kernel(cosine, kind), "a bigint, b bigint, links bigint"), "emb-found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b is not null").select("a", "b"))
    named = reps.select("node", "first").join(parts, "node")
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "component").select("node", "component_id")

    merged = reps.select("node", "label", "key", "first", "many").join(counts, "node", "left").join(named, "node", "left").where("many > 1 or links is not null")
    merged = merged.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component_id", "first").alias("component"))
    out = raws.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), "key").join(merged, ["label", "key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
u as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id as a, b.vec_id as b, a.e as x, b.e as y, a.n * b.n as n from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.n > 0 and b.n > 0),
l as (select a, b from p where list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i])) / n >= 0.93),
reach as (select a as n, a as r from l union select reach.n, l.b from reach join l on reach.r = l.a),
c as (select n, min(r) as c from reach group by n), k as (select a, count(*) as links from l group by a)
select vec_id, cast(coalesce(links, 0) as bigint) as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
from v left join c on c.n = vec_id left join k on k.a = vec_id
"""
