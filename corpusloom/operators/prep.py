"""Corpus preparation: de-duplication by key, merges, histograms, phrases, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import dedup_key, id_suffix
from corpusloom.lineage import materialize


def keyed_dedup(docs: DataFrame, seq: str = "doc_id", key: Column | None = None) -> DataFrame:
    """One row per key: the last record's columns at the first record's place, blank texts gone.
    Only (key, first, last) is grouped; texts travel once, in the join."""
    k = dedup_key("text") if key is None else key
    keyed = docs.withColumn("_key", k).where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\n\t\r", "   ")) != "")
    ends = keyed.groupBy("_key").agg(F.min(seq).alias("first_seq"), F.max(seq).alias(seq))
    return keyed.drop("_key").join(ends.select("first_seq", seq), seq)


def title_dedup(docs: DataFrame, seq: str = "doc_id") -> DataFrame:
    """As keyed_dedup with the first non-empty line as the key (D5); texts without one are gone."""
    return keyed_dedup(docs, seq, dedup_key("text", lines=1, chars=1 << 30))


def merge_outputs(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several generated files joined by id suffix, outputs in a map (J10). parts: name to (id, text, output)."""
    out = None
    for name, df in sorted(parts.items()):
        df = df.select(id_suffix("id").alias("suffix"), F.col("id"), F.col("text"), F.col("output").alias(f"o_{name}"))
        out = df if out is None else out.join(df.drop("id", "text"), "suffix")
    entries = F.array(*(F.struct(F.lit(n).alias("key"), F.col(f"o_{n}").alias("value")) for n in sorted(parts)))
    return out.select("id", "suffix", "text", F.map_from_entries(entries).alias("outputs"))


def merge_by_text(parts: dict[str, DataFrame]) -> DataFrame:
    """Full outer merge of (text, output) tables into a map per text (J11); of repeated texts in one table the largest output."""
    every = None
    for name, df in sorted(parts.items()):
        df = df.groupBy("text").agg(F.max("output").alias("output")).select("text", F.struct(F.lit(name).alias("key"), F.col("output").alias("value")).alias("e"))
        every = df if every is None else every.unionByName(df)
    return every.groupBy("text").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("outputs"))


def subset_histogram(docs: DataFrame, by: str = "source") -> DataFrame:
    return docs.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)


def length_histogram(docs: DataFrame, length: Column, width: int = 100) -> DataFrame:
    """Rows per length bucket."""
    return docs.groupBy((F.floor(length / width) * width).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def describe(docs: DataFrame, x: Column) -> DataFrame:
    """n, min, max, mean, sample variance, skewness and kurtosis."""
    return docs.select(x.cast("double").alias("x")).agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis")
    )


def weighted_average(rows: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("average"))


def distinct_queries(generated: DataFrame) -> DataFrame:
    """Distinct generated queries per passage with ids genQ1, genQ2, ... and their judgements (D7). generated(doc_id, query)."""
    rows = generated.select("doc_id", F.trim("query").alias("query")).where("query <> ''").distinct()
    rows = numbered(rows.withColumn("_k", F.struct("doc_id", "query")), "_k", "_i")
    return rows.select(F.concat(F.lit("genQ"), (F.col("_i") + 1).cast("string")).alias("qid"), "doc_id", "query", F.lit(1).alias("rel"))


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """rows with a dense number from 0 in the order of key: a range-partitioned sort, written once, and each
    partition's offset; no task sees more than its range."""
    ordered = materialize(rows.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_start")
    r = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return ordered.join(F.broadcast(starts), "_p").withColumn(out, (F.col("_start") + r - 1).cast("bigint")).drop("_p", "_start")


def ordered_totals(rows: DataFrame, order: list[Column], value: Column, ahead: Column | None = None) -> DataFrame:
    """rows with _i (from 1) and _upto (running sum of value) in the given order, and _next (ahead of the following row) if
    asked for. As in numbered, rows are dealt by ranges and one row per range is all that meets in one task."""
    named = rows.withColumn("_o", F.struct(*order)).withColumn("_v", value)
    named = named.withColumn("_a", ahead) if ahead is not None else named
    dealt = materialize(named.repartitionByRange("_o").withColumn("_p", F.spark_partition_id()), "ordered")
    w = Window.partitionBy("_p").orderBy("_o")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    per = [F.count("*").alias("_n"), F.sum("_v").alias("_s"), *([F.min_by("_a", "_o").alias("_f")] if ahead is not None else [])]
    starts = dealt.groupBy("_p").agg(*per)
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), *([F.lead("_f").over(Window.orderBy("_p")).alias("_f1")] if ahead is not None else []))
    out = dealt.join(F.broadcast(starts), "_p").withColumn("_i", F.col("_n0") + F.row_number().over(w)).withColumn("_upto", F.col("_s0") + F.sum("_v").over(upto))
    if ahead is not None:
        out = out.withColumn("_next", F.coalesce(F.lead("_a").over(w), "_f1")).drop("_a", "_f1")
    return out.drop("_o", "_v", "_p", "_n0", "_s0")


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """Key to a dense number from 0."""
    return numbered(rows.select(key).distinct(), key, "index")


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """rows concatenated with itself."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("copy", F.col("copy").cast("bigint"))


def overlap_counts(rows: DataFrame, a: Column, b: Column, special: list[str] | None = None) -> DataFrame:
    """Sizes of the intersection and union of two token arrays without special tokens."""
    drop = F.array(*(F.lit(s) for s in special)) if special else F.array().cast("array<string>")
    x, y = F.array_except(a, drop), F.array_except(b, drop)
    return rows.withColumn("n_overlap", F.size(F.array_intersect(x, y)).cast("bigint")).withColumn("n_union", F.size(F.array_union(x, y)).cast("bigint"))
