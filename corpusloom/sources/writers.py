"""Writers. Nesting happens here and nowhere before."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def qa_results(nested: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines of question, answers, hit_min_rank, all_hits, ctxs (K1)."""
    nested.write.mode(mode).json(path)


def recall_curve(curve: DataFrame, path: str) -> None:
    """recall_at_k.csv: k, recall in order of k (K2). A curve has as many rows as ranks."""
    curve.select("k", "recall").orderBy("k").coalesce(1).write.mode("overwrite").csv(path, header=True)


def wide_scores(scores: DataFrame, ks: list[int]) -> DataFrame:
    """metric, @1, @3, ... (K3)."""
    wide = scores.groupBy("metric").pivot("k", ks).agg(F.first("value"))
    return wide.select("metric", *(F.col(str(k)).alias(f"@{k}") for k in ks))


def benchmark_scores(scores: DataFrame, path: str, dataset: str, split: str = "test") -> None:
    """Result JSON with scores by family and metric@k, and the wide CSV beside it (K3)."""
    named = scores.withColumn("key", F.concat_ws("@", "metric", F.col("k").cast("string")))
    family = named.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    one = family.agg(F.map_from_entries(F.collect_list(F.struct(F.lower("metric"), "m"))).alias("scores"))
    one.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.lit("cos_sim").alias("metric"), "scores").coalesce(1).write.mode("overwrite").json(f"{path}/json")
    wide_scores(scores, sorted(r["k"] for r in scores.select("k").distinct().collect())).coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)


def corpus_json(docs: DataFrame, path: str) -> None:
    """_id, title, text, metadata lines (K4)."""
    cols = [F.col("doc_id").cast("string").alias("_id"), *(F.col(c) for c in ("title", "text", "metadata") if c in docs.columns)]
    docs.select(*cols).write.mode("overwrite").json(path)


def qrels_tsv(qrels: DataFrame, path: str) -> None:
    """query-id, corpus-id, score with a header (K4)."""
    qrels.select(F.col("qid").cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col("rel").cast("int").alias("score")).write.mode("overwrite").csv(path, sep="\t", header=True)


def generated_queries(rows: DataFrame, folder: str, prefix: str = "gen") -> None:
    """Queries and judgements of generated questions (K5): rows(qid, doc_id, query, rel)."""
    rows.select(F.col("qid").alias("_id"), F.col("query").alias("text")).write.mode("overwrite").json(f"{folder}/{prefix}-queries.jsonl")
    qrels_tsv(rows, f"{folder}/{prefix}-qrels/train.tsv")


def training_records(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def by_subset(docs: DataFrame, path: str, subset: str = "source") -> None:
    """One folder per subset, blanks in its name as underscores (K7). Rows are spread by subset and a salt, so a
    large subset is written by many tasks."""
    rows = docs.withColumn("subset", F.replace(F.col(subset), F.lit(" "), F.lit("_")))
    rows.repartition(F.col("subset"), F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.mode("overwrite").partitionBy("subset").json(path)


def bm25_statistics(index, path: str) -> None:
    """Document frequencies and corpus statistics; no per-document data (K8)."""
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def vector_index(vectors: DataFrame, path: str, model=None) -> None:
    """Vectors, and a fitted model beside them (K9); reading back checks the number of rows."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/size")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


def read_vector_index(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/vectors")
    if rows.count() != spark.read.parquet(f"{path}/size").first()["n"]:
        raise ValueError("the index does not have the rows it was written with")
    return rows


def id_map(ids: DataFrame, path: str) -> None:
    """key and index as TSV."""
    ids.write.mode("overwrite").csv(path, sep="\t", header=True)


def embedding_shards(vectors: DataFrame, path: str, shards: int, key: str = "id") -> None:
    """Contiguous ranges of ids, one file each."""
    vectors.repartitionByRange(shards, key).write.mode("overwrite").parquet(path)


def task_result(scores: DataFrame, path: str, overwrite: bool = False) -> None:
    """A task's result, kept if it is there already unless overwrite."""
    scores.coalesce(1).write.mode("overwrite" if overwrite else "ignore").json(path)


#: Fields of a result that a model card leaves out.
CARD_SKIPS = ("std", "evaluation_time", "main_score", "threshold")


def model_card(scores: DataFrame) -> DataFrame:
    """Lines of model-card metadata (K11): scores(task, metric, value) times 100, without bookkeeping fields."""
    kept = scores.where(~F.col("metric").rlike("|".join(CARD_SKIPS)))
    return kept.select("task", F.concat(F.lit("- type: "), F.col("metric"), F.lit("\n  value: "), F.round(F.col("value") * 100, 4).cast("string")).alias("line"))
