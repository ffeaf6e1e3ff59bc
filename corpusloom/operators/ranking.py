"""Ranking metrics over long tables: run(qid, doc_id, score), qrels(qid, doc_id, rel).

Ranks order by score descending, then doc_id. Two families are kept apart: the ``trec`` one
(graded gain, all relevant documents in the ideal) and the ``binary`` one (hits only,
denominators capped at k). Every metric is one long row (metric, k, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by_rank():
    return Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))


def without_self(run: DataFrame) -> DataFrame:
    """Drops a query's own document."""
    return run.where(F.col("qid") != F.col("doc_id"))


def ranked(run: DataFrame, k: int | None = None) -> DataFrame:
    """run with rank (W1); only the first k. The limit reaches below the shuffle as a group limit."""
    out = run.withColumn("rank", F.row_number().over(_by_rank()))
    return out if k is None else out.where(F.col("rank") <= k)


def judged(run: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """Ranked run with rel, 0 where not judged."""
    return ranked(run, k).join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _ideal(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: relevant documents, and the ideal graded DCG at each k."""
    r = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("doc_id")))
    gains = qrels.where("rel > 0").withColumn("r", r).withColumn("g", F.col("rel") / F.log2(F.col("r") + 1.0))
    return gains.groupBy("qid").agg(F.count("*").alias("n_rel"), *(F.sum(F.when(F.col("r") <= k, F.col("g")).otherwise(0.0)).alias(f"ideal_{k}") for k in ks))


def _long(wide: DataFrame, metrics: dict[tuple[str, int], Column]) -> DataFrame:
    """One aggregated row to (metric, k, value)."""
    one = wide.agg(*(c.alias(f"{m}_{k}") for (m, k), c in metrics.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for m, k in metrics)))
    return one.select(rows.alias("x")).select("x.metric", F.col("x.k").cast("bigint").alias("k"), F.col("x.value").cast("double").alias("value"))


def _hits(run: DataFrame, qrels: DataFrame, most: int) -> DataFrame:
    running = F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return judged(run, qrels, most).withColumn("hits", running)


def trec_metrics(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """NDCG, MAP, Recall and P at each k (A1-A3), means over queries in both run and qrels."""
    top = _hits(run, qrels, max(ks))
    hit = F.col("rel") > 0
    per = [
        c
        for k in ks
        for c in (
            F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when((F.col("rank") <= k) & hit, F.col("hits") / F.col("rank")).otherwise(0.0)).alias(f"ap_{k}"),
            F.sum(F.when((F.col("rank") <= k) & hit, 1.0).otherwise(0.0)).alias(f"hit_{k}"),
        )
    ]
    by_query = top.groupBy("qid").agg(*per).join(qrels.select("qid").distinct(), "qid", "left_semi").join(_ideal(qrels, ks), "qid", "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return _long(
        by_query,
        {
            key: F.avg(c)
            for k in ks
            for key, c in {("NDCG", k): ratio(f"dcg_{k}", f"ideal_{k}"), ("MAP", k): ratio(f"ap_{k}", "n_rel"), ("Recall", k): ratio(f"hit_{k}", "n_rel"), ("P", k): F.col(f"hit_{k}") / k}.items()
        },
    )


def _over_qrels(top: DataFrame, qrels: DataFrame, per: list[Column]) -> DataFrame:
    """Aggregates of the run for every query of qrels; null where the run has none."""
    n_rel = qrels.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("n_rel"))
    return n_rel.join(top.groupBy("qid").agg(*per), "qid", "left")


def mrr(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Reciprocal rank of the first relevant document, over all queries of qrels (A4)."""
    first = F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first")
    q = _over_qrels(judged(run, qrels, max(ks)), qrels, [first])
    return _long(q, {("MRR", k): F.avg(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)) for k in ks})


def recall_cap(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Hits over min(relevant, k); queries without relevant documents count 0 (A5)."""
    per = [F.sum(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    q = _over_qrels(judged(run, qrels, max(ks)), qrels, per)
    return _long(q, {("R_cap", k): F.avg(F.coalesce(F.try_divide(F.col(f"hit_{k}"), F.least("n_rel", F.lit(k))), F.lit(0.0))) for k in ks})


def hole(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Share of the first k that no query's judgements mention."""
    top = ranked(run, max(ks)).join(qrels.select("doc_id").distinct(), "doc_id", "left_anti")
    q = _over_qrels(top, qrels, [F.sum(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hole_{k}") for k in ks])
    return _long(q, {("Hole", k): F.avg(F.coalesce(F.col(f"hole_{k}"), F.lit(0.0)) / k) for k in ks})


def accuracy(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries with a relevant document in the first k."""
    first = F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first")
    q = _over_qrels(judged(run, qrels, max(ks)), qrels, [first])
    return _long(q, {("Accuracy", k): F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)) for k in ks})


#: Metric aliases.
CUSTOM = {
    **dict.fromkeys(("mrr", "mrr@k", "mrr_cut"), mrr),
    **dict.fromkeys(("recall_cap", "r_cap", "r_cap@k"), recall_cap),
    **dict.fromkeys(("hole", "hole@k"), hole),
    **dict.fromkeys(("acc", "top_k_acc", "accuracy", "accuracy@k", "top_k_accuracy"), accuracy),
}


def custom(name: str, run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    if name.lower() not in CUSTOM:
        raise ValueError(f"no such metric: {name}; one of {sorted(CUSTOM)}")
    return CUSTOM[name.lower()](run, qrels, ks)


def binary_metrics(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """The binary family (A9): accuracy, precision, recall, MRR, NDCG and MAP over queries with a relevant document."""
    positive = qrels.where("rel > 0")
    most = max(ks)
    top = _hits(run, positive, most)
    hit = F.col("rel") > 0
    per = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        here = hit & (F.col("rank") <= k)
        per += [
            F.sum(F.when(here, 1.0).otherwise(0.0)).alias(f"hit_{k}"),
            F.sum(F.when(here, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(here, F.col("hits") / F.col("rank")).otherwise(0.0)).alias(f"ap_{k}"),
        ]
    q = _over_qrels(top, positive, per)
    q = q.select("qid", "n_rel", "first", *(F.coalesce(c, F.lit(0.0)).alias(c) for k in ks for c in (f"hit_{k}", f"dcg_{k}", f"ap_{k}")))
    out = {}
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
        out |= {
            ("accuracy", k): F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)),
            ("precision", k): F.avg(F.col(f"hit_{k}") / k),
            ("recall", k): F.avg(F.col(f"hit_{k}") / F.col("n_rel")),
            ("mrr", k): F.avg(F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0)),
            ("ndcg", k): F.avg(F.col(f"dcg_{k}") / ideal),
            ("map", k): F.avg(F.col(f"ap_{k}") / F.least(F.col("n_rel"), F.lit(k))),
        }
    return _long(q, out)


def presented(metrics: DataFrame, digits: int = 5) -> DataFrame:
    """Names as reports have them (A45): ndcg_at_10, value rounded."""
    return metrics.select(F.concat(F.lower("metric"), F.lit("_at_"), F.col("k").cast("string")).alias("metric"), F.round("value", digits).alias("value"))


def macro_average(scores: DataFrame, capped: str = "trec-covid", groups: dict[str, str] | None = None) -> DataFrame:
    """Mean over datasets of scores(dataset, metric, k, value): the capped dataset's recall is its R_cap, and
    datasets of one group (dataset name to group name) are averaged first (A12)."""
    wanted = F.when(F.col("dataset") == capped, F.when(F.col("metric") == "R_cap", F.lit("Recall")).when(F.col("metric") != "Recall", F.col("metric"))).when(F.col("metric") != "R_cap", F.col("metric"))
    rows = scores.withColumn("metric", wanted).where("metric is not null")
    if groups:
        name = F.create_map(*(F.lit(x) for kv in sorted(groups.items()) for x in kv))[F.col("dataset")]
        rows = rows.withColumn("dataset", F.coalesce(name, F.col("dataset"))).groupBy("dataset", "metric", "k").agg(F.avg("value").alias("value"))
    return rows.groupBy("metric", "k").agg(F.avg("value").alias("value"), F.count("*").alias("n_datasets"))


def score_pivot(scores: DataFrame, metrics: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """Dataset by metric, 0.0 where missing (A43). The metrics are given, so no pass is spent on finding them."""
    value = F.col("value")
    for m, s in (scale or {}).items():
        value = F.when(F.col("metric") == m, value * s).otherwise(value)
    return scores.withColumn("value", value).groupBy("dataset").pivot("metric", metrics).agg(F.first("value")).na.fill(0.0)


def suite_average(scores: DataFrame, tasks: list[str]) -> DataFrame:
    """Mean over a suite's tasks, a missing one counting 0."""
    spark = scores.sparkSession
    names = spark.createDataFrame([(t,) for t in tasks], "task string")
    return names.join(scores, "task", "left").agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("value"), F.count("value").alias("n_found"))
