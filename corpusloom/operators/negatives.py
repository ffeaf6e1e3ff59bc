"""Negative mining and the nested training records it feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rand import below

from .prep import dense_ids
from .ranking import ranked


def first_positive(qrels: DataFrame) -> DataFrame:
    """(qid, doc_id): the relevant document with the smallest id."""
    return qrels.where("rel > 0").groupBy("qid").agg(F.min("doc_id").alias("doc_id"))


def hard_negatives(run: DataFrame, qrels: DataFrame, n: int, exclude: str = "first") -> DataFrame:
    """The first n of a run less the positives: the first one only, or all."""
    gone = first_positive(qrels) if exclude == "first" else qrels.where("rel > 0").select("qid", "doc_id")
    left = run.where(F.col("rank") <= n).select("qid", "doc_id", "score").join(gone, ["qid", "doc_id"], "left_anti")
    return ranked(left)


def random_negatives(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement per query, then the first positive is dropped, so fewer may stay."""
    ids = dense_ids(corpus, "doc_id")
    size = ids.agg(F.count("*").alias("size"))
    draws = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).join(F.broadcast(size))
    draws = draws.withColumn("index", below(seed, F.col("size"), F.col("qid"), F.col("draw"))).drop("size")
    return draws.join(ids, "index").join(first_positive(qrels), ["qid", "doc_id"], "left_anti").select("qid", F.col("draw").cast("bigint").alias("draw"), "doc_id")


def training_records(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, negatives: DataFrame | None = None, hard: DataFrame | None = None, dataset: str = "") -> DataFrame:
    """Nested records: question, its first positive, and negatives by rank."""
    ctx = lambda score: F.struct(F.coalesce("title", F.lit("")).alias("title"), "text", F.col("doc_id").cast("string").alias("passage_id"), score.alias("score"))

    def nest(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.join(corpus.select("doc_id", "title", "text"), "doc_id")
        at = F.struct(F.col("_at"), ctx(F.col("_score")).alias("ctx"))
        return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["ctx"]).alias(name))

    out = queries.select("qid", F.col("text").alias("question"))
    positive = first_positive(qrels).withColumn("_at", F.lit(0)).withColumn("_score", F.lit(None).cast("double"))
    out = out.join(nest(positive, "positive_ctxs"), "qid")
    for rows, name in ((negatives, "negative_ctxs"), (hard, "hard_negative_ctxs")):
        if rows is not None:
            at = "rank" if "rank" in rows.columns else "draw"
            score = F.col("score") if "score" in rows.columns else F.lit(None).cast("double")
            out = out.join(nest(rows.select("qid", "doc_id", F.col(at).alias("_at"), score.alias("_score")), name), "qid", "left")
    ctxs = "array<struct<title:string,text:string,passage_id:string,score:double>>"
    for name in ("negative_ctxs", "hard_negative_ctxs"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast(ctxs)) if name in out.columns else F.array().cast(ctxs))
    return out.select(F.lit(dataset).alias("dataset"), F.col("qid").cast("string").alias("question_id"), "question", F.array().cast("array<string>").alias("answers"), "positive_ctxs", "negative_ctxs", "hard_negative_ctxs")
