"""Evaluators over pairs: similarity correlation, pair classification, reranking, summaries, bitext."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import ordered_totals
from .ranking import ranked


def average_ranks(rows: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks with ties averaged (W7), within groups of by. Distinct values are counted first and summed up by ranges, so
    neither a large group nor the whole table is sorted in one task."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = ordered_totals(counts, [F.col(c) for c in (*by, value)], F.col("_n")).select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out), (F.col("_upto") - F.col("_n")).alias("_from"))
    if by:
        start = upto.groupBy(*by).agg(F.min("_from").alias("_start"))
        upto = upto.join(start, by).withColumn(out, F.col(out) - F.col("_start")).drop("_start")
    mine = upto.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, value))), out)
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*by, value))))
    return rows.join(mine, same).drop(*(f"_k{i}" for i in range(len(by) + 1)))


def correlations(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson and Spearman of x and y (A21); null for a constant column. by: per group."""
    by = by or []
    r = average_ranks(average_ranks(rows.select(*by, x, y), x, "_rx", by), y, "_ry", by)

    def corr(a, b):
        n, sa, sb = F.count("*"), F.sum(a), F.sum(b)
        cov = F.sum(F.col(a) * F.col(b)) - sa * sb / n
        va, vb = F.sum(F.col(a) * F.col(a)) - sa * sa / n, F.sum(F.col(b) * F.col(b)) - sb * sb / n
        return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), cov / F.sqrt(F.when((va > 0) & (vb > 0), va * vb)))

    return r.groupBy(*by).agg(corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def sts_summary(per_set: DataFrame) -> DataFrame:
    """Unweighted and size-weighted means over data sets."""
    weighted = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return per_set.agg(F.avg("pearson").alias("pearson_mean"), weighted("pearson").alias("pearson_wmean"), F.avg("spearman").alias("spearman_mean"), weighted("spearman").alias("spearman_wmean"))


def pair_classification(rows: DataFrame) -> DataFrame:
    """Best accuracy and F1 with their thresholds, and average precision, of rows(pair_id, score, label).
    Cuts lie between neighbours by score; the last row is no cut; the first best cut counts.
    The running counts are summed up by ranges of scores."""
    total = rows.agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    r = ordered_totals(rows.select("pair_id", "score", "label"), [-F.col("score"), F.col("pair_id")], F.col("label"), F.col("score"))
    r = r.withColumnsRenamed({"_upto": "tp", "_i": "i", "_next": "next"}).join(F.broadcast(total))
    r = r.withColumn("threshold", (F.col("score") + F.col("next")) / 2)
    cuts = r.where("i < n").withColumn("accuracy", (F.col("tp") + (F.col("n") - F.col("pos")) - (F.col("i") - F.col("tp"))) / F.col("n")).withColumn("f1", F.try_divide(2.0 * F.col("tp"), F.col("i") + F.col("pos")))
    best = lambda m: F.min_by(F.struct(F.col(m).alias("value"), "threshold"), F.struct((-F.col(m)).alias("v"), "i"))
    top = cuts.agg(best("accuracy").alias("a"), best("f1").alias("f"))
    tied = r.groupBy("score").agg(F.max("i").alias("i"), F.max("tp").alias("tp"), F.sum("label").alias("here"), F.first("pos").alias("pos"))
    ap = tied.agg(F.sum(F.col("here") / F.col("pos") * F.col("tp") / F.col("i")).alias("ap"))
    return top.join(ap).select(F.col("a.value").alias("accuracy"), F.col("a.threshold").alias("accuracy_threshold"), F.col("f.value").alias("f1"), F.col("f.threshold").alias("f1_threshold"), "ap")


def reranking(rows: DataFrame, k: int = 10, mixed_only: bool = True) -> DataFrame:
    """MAP and MRR@k of rows(sample_id, subquery_id, cand_id, score, relevant): a candidate scores its best
    sub-query; samples without positives or negatives are dropped (A25, P12). Without mixed_only they stay: one without
    positives has an MRR of 0 and no part in the MAP."""
    best = rows.groupBy("sample_id", "cand_id").agg(F.max("score").alias("score"), F.max("relevant").alias("relevant"))
    if mixed_only:
        mixed = best.groupBy("sample_id").agg(F.min("relevant").alias("lo"), F.max("relevant").alias("hi")).where("lo < hi")
        best = best.join(mixed, "sample_id", "left_semi")
    top = ranked(best.select(F.col("sample_id").alias("qid"), F.col("cand_id").alias("doc_id"), "score", "relevant"))
    hits = F.sum("relevant").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    per = top.withColumn("hits", hits).groupBy("qid").agg(F.avg(F.when(F.col("relevant") == 1, F.col("hits") / F.col("rank"))).alias("ap"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"))
    return per.agg(F.avg("ap").alias("map"), F.avg(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)).alias("mrr"))


def summarization(rows: DataFrame) -> DataFrame:
    """Mean over texts of the correlation between a machine summary's best similarity to any human one and its
    relevance; texts with constant values are skipped (A26). rows(text_id, machine_id, similarity, relevance).
    The mean is over the statistics alone."""
    best = rows.groupBy("text_id", "machine_id").agg(F.max("similarity").alias("similarity"), F.max("relevance").alias("relevance"))
    per = correlations(best, "similarity", "relevance", ["text_id"])
    return per.where("pearson is not null").agg(F.avg("pearson").alias("pearson"), F.avg("spearman").alias("spearman"), F.count("*").alias("n_texts"))


def weighted_prf(rows: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by the gold class's size, of rows(gold, predicted)."""
    gold = rows.groupBy(F.col("gold").alias("c")).agg(F.count("*").alias("n_gold"), F.sum(F.when(F.col("gold") == F.col("predicted"), 1).otherwise(0)).alias("tp"))
    pred = rows.groupBy(F.col("predicted").alias("c")).agg(F.count("*").alias("n_pred"))
    per = gold.join(pred, "c", "left").withColumn("p", F.coalesce(F.col("tp") / F.col("n_pred"), F.lit(0.0))).withColumn("r", F.col("tp") / F.col("n_gold"))
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    mean = lambda c: F.sum(F.col(c) * F.col("n_gold")) / F.sum("n_gold")
    return per.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), (F.sum("tp") / F.sum("n_gold")).alias("accuracy"), F.avg("f").alias("macro_f1"))


def knn_votes(run: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(qid, predicted): the most frequent label among the k nearest, the smaller of equals."""
    near = run.where(F.col("rank") <= k).join(labels.select("doc_id", "label"), "doc_id").groupBy("qid", "label").agg(F.count("*").alias("votes"))
    return near.groupBy("qid").agg(F.min_by("label", F.struct((-F.col("votes")).alias("v"), "label")).alias("predicted"))


def v_measure(rows: DataFrame) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean from contingency counts of rows(label, cluster)."""
    cell = rows.groupBy("label", "cluster").agg(F.count("*").alias("n"))
    total = cell.agg(F.sum("n").alias("t"))
    entropy = lambda by: cell.groupBy(by).agg(F.sum("n").alias("n")).join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t"))).alias(f"h_{by}"))
    both = cell.join(F.broadcast(total)).agg(F.sum(-F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t"))).alias("h"))
    r = entropy("label").join(entropy("cluster")).join(both)
    hom = F.when(F.col("h_label") == 0, 1.0).otherwise(1 - (F.col("h") - F.col("h_cluster")) / F.col("h_label"))
    com = F.when(F.col("h_cluster") == 0, 1.0).otherwise(1 - (F.col("h") - F.col("h_label")) / F.col("h_cluster"))
    r = r.select(hom.alias("homogeneity"), com.alias("completeness"))
    return r.withColumn("v_measure", F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness"))))


def caption_ranks(run: DataFrame, own: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """R@k (in percent) and median rank of the best own caption (A34). own(qid, doc_id). Queries whose
    captions the run does not reach don't count; rank_summary of search.own_ranks counts them all."""
    return rank_summary(run.join(own, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r")), ks)


def rank_summary(best: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """R@k (in percent) and median of best(qid, r), over all its queries."""
    median = (F.floor(F.percentile(F.col("r") - 1, F.lit(0.5))) + 1).cast("bigint")
    return best.agg(*(F.avg(F.when(F.col("r") <= k, 100.0).otherwise(0.0)).alias(f"r{k}") for k in ks), median.alias("median_rank"))


def alignment_uniformity(pairs: DataFrame, alpha: float = 2.0, t: float = 2.0) -> DataFrame:
    """Mean distance^alpha of positive pairs, and ln mean exp(-t d^2) of all pairs (A35). pairs(d, positive)."""
    return pairs.agg(F.avg(F.when(F.col("positive"), F.pow("d", F.lit(alpha)))).alias("alignment"), F.ln(F.avg(F.exp(-t * F.col("d") * F.col("d")))).alias("uniformity"))
