"""Sampling and augmentation with deterministic draws: the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.rand import below, uniform
from corpusloom.functions.text import bound

from .prep import numbered


def crop_length(n: Column, seed: int, key: Column, min_len: float, max_len: float, min_cap: int, max_cap: int) -> Column:
    """A length drawn from {least..most}; bounds up to 1 are shares of n (G1)."""
    bound = lambda b: F.ceil(n * b).cast("bigint") if b <= 1 else F.lit(int(b)).cast("bigint")
    least = F.greatest(bound(min_len), F.lit(min_cap).cast("bigint"))
    most = F.least(bound(max_len), F.lit(max_cap).cast("bigint"))
    least, most = F.least(least, n), F.least(F.greatest(most, least), n)
    return least + below(seed, most - least + 1, key, F.lit("len"))


def crop(tokens: Column, seed: int, key: Column, min_len: float = 0.05, max_len: float = 0.5, min_cap: int = 4, max_cap: int = 64, crop_to_maxlen: bool = False) -> Column:
    """A contiguous run of tokens; the whole where crop_to_maxlen and it is short enough (G1)."""
    n = F.size(tokens).cast("bigint")
    length = crop_length(n, seed, key, min_len, max_len, min_cap, max_cap)
    start = below(seed, n - length + 1, key, F.lit("start"))
    out = F.slice(tokens, (start + 1).cast("int"), length.cast("int"))
    if crop_to_maxlen:
        most = F.ceil(n * max_len) if max_len <= 1 else F.lit(int(max_len))
        out = F.when(n <= most, tokens).otherwise(out)
    return F.when(n == 0, tokens).otherwise(out)


def word_replace(tokens: Column, seed: int, key: Column, ratio: float, mask: bool = False) -> Column:
    """Tokens deleted, or masked, each with the given probability."""
    hit = lambda i: uniform(seed, key, i) < ratio
    if mask:
        return F.transform(tokens, lambda t, i: F.when(hit(i), F.lit("[MASK]")).otherwise(t))
    return F.filter(tokens, lambda t, i: ~hit(i))


def replace_ids(ids: Column, seed: int, key: Column, ratio: float, vocab: int) -> Column:
    """Ids replaced by random ones with the given probability."""
    return F.transform(ids, lambda x, i: F.when(uniform(seed, key, i) < ratio, below(seed + 1, F.lit(vocab), key, i)).otherwise(x.cast("bigint")))


def shuffle_some(tokens: Column, seed: int, key: Column, ratio: float) -> Column:
    """The chosen positions' tokens in a random order, the others in place (G3). Chosen and other positions are sorted
    back into place together, so no position is searched for."""

    def placed(t: Column) -> Column:
        numbered = F.transform(t, lambda x, i: F.struct(i.cast("bigint").alias("i"), (uniform(seed, key, i.cast("bigint")) < ratio).alias("hit"), x.alias("t")))
        return bound(numbered, shuffled)

    def shuffled(numbered: Column) -> Column:
        chosen = F.filter(numbered, lambda x: x["hit"])
        drawn = F.sort_array(F.transform(chosen, lambda x: F.struct(uniform(seed + 1, key, x["i"]).alias("u"), x["i"].alias("i"), x["t"].alias("t"))))
        moved = F.zip_with(chosen, drawn, lambda x, y: F.struct(x["i"].alias("i"), y["t"].alias("t")))
        stay = F.transform(F.filter(numbered, lambda x: ~x["hit"]), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))
        return F.transform(F.sort_array(F.concat(moved, stay)), lambda x: x["t"])

    return bound(tokens, placed)


def mlm_mask(tokens: Column, seed: int, key: Column, vocab: Column, ratio: float = 0.15) -> Column:
    """Of a share of tokens 80 % masked, 10 % replaced from vocab, 10 % kept."""

    def one(t, i):
        u = uniform(seed + 1, key, i)
        other = F.get(vocab, below(seed + 2, F.size(vocab), key, i).cast("int"))
        return F.when(uniform(seed, key, i) >= ratio, t).when(u < 0.8, F.lit("[MASK]")).when(u < 0.9, other).otherwise(t)

    return F.transform(tokens, one)


def chunks(rows: DataFrame, tokens: str, seed: int, key: str, size: int) -> DataFrame:
    """Chunks of `size` tokens from a random offset below size; a text shorter than that is one chunk."""
    n = F.size(tokens)
    offset = F.when(n >= 2 * size, below(seed, F.lit(size), F.col(key))).otherwise(F.lit(0)).cast("int")
    starts = F.when(n < size, F.array(F.lit(0))).otherwise(F.sequence(offset, n - size, F.lit(size)))
    out = rows.where(n > 0).select(key, F.col(tokens), F.posexplode(starts).alias("chunk", "start"))
    return out.select(key, F.col("chunk").cast("bigint").alias("chunk"), F.slice(F.col(tokens), F.col("start") + 1, F.lit(size)).alias("tokens"))


def weighted_choice(u: Column, choices: list[tuple[Column, float]]) -> Column:
    """The value whose cumulative weight first exceeds u times the total; null values take no part."""
    weights = [F.when(v.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for v, w in choices]
    point = u * sum(weights[1:], weights[0])
    out, upto = None, F.lit(0.0)
    for (v, _), w in zip(choices, weights, strict=True):
        upto = upto + w
        hit = (point < upto) & (w > 0)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def interleave(parts: list[DataFrame], key: str) -> DataFrame:
    """Round-robin until the shortest ends (G13 a). Adds source, turn and position."""
    turns = [numbered(p.withColumn("source", F.lit(i).cast("bigint")), key, "turn") for i, p in enumerate(parts)]
    every = turns[0]
    for p in turns[1:]:
        every = every.unionByName(p)
    shortest = every.groupBy("source").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return every.join(F.broadcast(shortest)).where("turn < least").drop("least").withColumn("position", F.col("turn") * len(parts) + F.col("source"))


def tiled(rows: DataFrame, key: str, steps: int) -> DataFrame:
    """One source read cyclically for a number of steps (G13 b)."""
    rows = numbered(rows, key, "_at")
    n = rows.agg(F.count("*").alias("n"))
    ids = rows.sparkSession.range(steps).select(F.col("id").alias("step")).join(F.broadcast(n)).withColumn("_at", F.col("step") % F.col("n")).drop("n")
    return ids.join(rows, "_at").drop("_at")


def weighted_interleave(parts: list[DataFrame], key: str, probabilities: list[float], steps: int, seed: int) -> DataFrame:
    """Each step draws a source, which gives its next row, cyclically (G13 c, W9)."""
    u = uniform(seed, F.col("step"))
    upto, source = 0.0, None
    for i, p in enumerate(probabilities):
        upto += p / sum(probabilities)
        source = F.when(u < upto, i) if source is None else source.when(u < upto, i)
    plan = parts[0].sparkSession.range(steps).select(F.col("id").alias("step")).withColumn("source", F.coalesce(source, F.lit(len(parts) - 1)).cast("bigint"))
    plan = numbered(plan.withColumn("_k", F.struct("source", "step")), "_k", "_n").drop("_k")
    first = plan.groupBy("source").agg(F.min("_n").alias("_first"))  # one row per source
    plan = plan.join(F.broadcast(first), "source").withColumn("draw", F.col("_n") - F.col("_first")).drop("_n", "_first")
    every = None
    for i, p in enumerate(parts):
        p = numbered(p.withColumn("source", F.lit(i).cast("bigint")), key, "_at")
        every = p if every is None else every.unionByName(p)
    sizes = every.groupBy("source").agg(F.count("*").alias("n"))
    plan = plan.join(F.broadcast(sizes), "source").withColumn("_at", F.col("draw") % F.col("n")).drop("n", "draw")
    return plan.join(every, ["source", "_at"]).drop("_at")


def smoothed_shares(rows: DataFrame, by: str, power: float) -> DataFrame:
    """p proportional to n^power."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.pow("n", F.lit(power)) / F.sum(F.pow("n", F.lit(power))).over(Window.partitionBy(F.lit(0))))


def mixed(a: Column, b: Column, p: float, seed: int, key: Column) -> Column:
    """a with probability p, else b."""
    return F.when(uniform(seed, key) < p, a).otherwise(b)


def undersample(rows: DataFrame, label: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows of each label by hash order."""
    w = Window.partitionBy(label).orderBy(uniform(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def rank_stride(rows: DataFrame, key: str, world: int, seed: int) -> DataFrame:
    """The rank that gets each row in a shuffled, strided split."""
    rows = numbered(rows.withColumn("_u", F.struct(uniform(seed, F.col(key)).alias("u"), F.col(key).alias("k"))), "_u", "position")
    return rows.drop("_u").withColumn("rank", F.col("position") % world)


def mandatory_plus_sample(docs: DataFrame, needed: DataFrame, size: int, seed: int) -> DataFrame:
    """All needed documents and the hash-first others up to size."""
    must = docs.join(needed.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("needed", F.lit(True))
    rest = docs.join(needed.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("needed", F.lit(False))
    left = max(0, size - must.count())
    return must.unionByName(rest.orderBy(uniform(seed, F.col("doc_id")), "doc_id").limit(left))


#: A named configuration of the pair builder.
CONFIGS = {"contriever256": {"max_context_len": 256, "min_dq_len": 0.05, "max_dq_len": 0.5, "min_q_len": 0.05, "max_q_len": 0.5, "word_del_ratio": 0.1}}


def config(name: str, override: str | None = None) -> dict:
    """A named configuration with overrides from a JSON object."""
    import json

    return {**CONFIGS[name], **(json.loads(override) if override else {})}
