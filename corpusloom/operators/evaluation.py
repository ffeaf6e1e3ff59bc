"""Model-backed evaluations (clustering, classification, relatedness) and the task catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vector as V
from corpusloom.functions.rand import uniform

from corpusloom.lineage import materialize

from .pairs import correlations, v_measure
from .sampling import undersample
from .search import exact_search


def _features(vectors: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(V.doubles("embedding")).alias("features"))


def clustering_quality(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """V-measure of k-means with as many clusters as labels."""
    from pyspark.ml.clustering import KMeans

    x = _features(vectors)
    k = x.select("label").distinct().count()
    found = KMeans(k=k, seed=seed, maxIter=20).fit(x).transform(x).select("label", F.col("prediction").alias("cluster"))
    return v_measure(found).withColumn("k", F.lit(k).cast("bigint"))


def assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """vectors(vec_id, label, embedding) with the nearest of centres(cluster, embedding), the smaller number of equals.
    There is one centre per cluster, so the search multiplies each batch with a block of them."""
    near = exact_search(vectors.select(F.col("vec_id").alias("qid"), "embedding"), centres.select(F.col("cluster").alias("doc_id"), "embedding"), 1, "euclidean")
    return vectors.join(near.select(F.col("qid").alias("vec_id"), F.col("doc_id").alias("cluster")), "vec_id")


def lloyd(vectors: DataFrame, rounds: int) -> DataFrame:
    """Clusters after so many rounds of k-means from each label's first vector as a centre (A28): the assignment."""
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    centres = materialize(first.select(F.col("label").cast("bigint").alias("cluster"), V.doubles("embedding").alias("embedding")), "centres")
    for _ in range(rounds - 1):
        parts = assigned(vectors, centres).select("cluster", F.posexplode(V.doubles("embedding")).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
        means = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
        centres = materialize(means, "centres")
    return assigned(vectors, centres)


def _logistic(rows: DataFrame, penalty: float):
    """Multinomial logistic regression with an L2 penalty on the raw features."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=100, regParam=penalty, standardization=False, family="multinomial").fit(rows)


def _accuracy(model, rows: DataFrame) -> float:
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def logistic_experiments(vectors: DataFrame, experiments: int, per_label: int, seed: int = 11, penalty: float = 0.01) -> DataFrame:
    """Accuracy of logistic regression on balanced samples of the training split: mean and its population deviation."""
    train, test = vectors.where("vec_id % 5 <> 0"), _features(vectors.where("vec_id % 5 = 0")).cache()
    got = [(i, _accuracy(_logistic(_features(undersample(train, "label", per_label, seed + i, "vec_id")), penalty), test)) for i in range(experiments)]
    test.unpersist()
    out = vectors.sparkSession.createDataFrame(got, "experiment int, accuracy double")
    return out.agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.stddev_pop("accuracy"), 6).alias("accuracy_stderr"), F.count("*").alias("n_experiments"))


def fold_of(vectors: DataFrame, folds: int, seed: int = 5) -> DataFrame:
    return _features(vectors).withColumn("fold", F.floor(uniform(seed, F.col("vec_id")) * folds).cast("int"))


def _picked(rows: DataFrame, folds: list[int], grid) -> tuple[float, float]:
    """The penalty with the best mean accuracy over the folds, the first of equals, and that accuracy."""
    means = []
    for penalty in grid:
        got = [_accuracy(_logistic(rows.where(F.col("fold") != k), penalty), rows.where(F.col("fold") == k)) for k in folds]
        means.append(sum(got) / len(got))
    best = max(range(len(grid)), key=lambda i: (means[i], -i))
    return grid[best], means[best]


def nested_folds(vectors: DataFrame, folds: int = 3, grid=(0.001, 0.1)) -> DataFrame:
    """Nested cross-validation (A31): for every outer fold the penalty is picked by the inner folds and tested on it."""
    x = fold_of(vectors, folds).cache()
    out = []
    for k in range(folds):
        inner = x.where(F.col("fold") != k)
        penalty, dev = _picked(inner, [f for f in range(folds) if f != k], grid)
        out.append((k, float(penalty), round(dev, 6), round(_accuracy(_logistic(inner, penalty), x.where(F.col("fold") == k)), 6)))
    x.unpersist()
    return vectors.sparkSession.createDataFrame(out, "fold int, penalty double, dev_accuracy double, test_accuracy double")


def folds_and_test(train: DataFrame, test: DataFrame, folds: int = 3, grid=(0.001, 0.1)) -> DataFrame:
    """The penalty picked by folds of the training rows, tested on rows of their own."""
    x = fold_of(train, folds).cache()
    penalty, dev = _picked(x, list(range(folds)), grid)
    got = _accuracy(_logistic(x, penalty), _features(test))
    x.unpersist()
    return train.sparkSession.createDataFrame([(float(penalty), round(dev, 6), round(got, 6))], "penalty double, dev_accuracy double, test_accuracy double")


def split_test(train: DataFrame, valid: DataFrame, test: DataFrame, grid=(0.001, 0.1)) -> DataFrame:
    """The penalty picked on a validation split, tested on a test split."""
    x = _features(train).withColumn("fold", F.lit(0)).unionByName(_features(valid).withColumn("fold", F.lit(1))).cache()
    penalty, dev = _picked(x, [1], grid)
    got = _accuracy(_logistic(x.where("fold = 0"), penalty), _features(test))
    x.unpersist()
    return train.sparkSession.createDataFrame([(float(penalty), round(dev, 6), round(got, 6))], "penalty double, dev_accuracy double, test_accuracy double")


def soft_labels(score, classes: int = 5):
    """A score from 1 to `classes` as weights of its two neighbouring classes."""
    low = F.floor(score)
    return F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda k: F.when(k == low, low + 1 - score).when(k == low + 1, score - low).otherwise(0.0))


def relatedness(vectors: DataFrame) -> DataFrame:
    """Relatedness regression over soft classes on pair features: one model per class, the expected class as the score."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    a = vectors.select("vec_id", F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    rows = a.join(b, "vec_id").withColumn("gold", 1 + F.abs(F.col("la") - F.col("lb")) * 4 / 9.0).withColumn("soft", soft_labels(F.col("gold")))
    rows = rows.select("vec_id", "gold", "soft", array_to_vector(V.pair_features(V.doubles("a"), V.doubles("b"))).alias("features"))
    score = F.lit(0.0)
    scored = rows
    for k in range(5):
        model = LinearRegression(featuresCol="features", labelCol="y", predictionCol=f"p{k}", regParam=0.1, solver="normal", standardization=False).fit(rows.where("vec_id % 3 <> 0").withColumn("y", F.get("soft", F.lit(k))))
        scored = model.transform(scored)
        score = score + (k + 1) * F.col(f"p{k}")
    test = scored.where("vec_id % 3 = 0").withColumn("score", score)
    mse = test.agg(F.avg((F.col("score") - F.col("gold")) * (F.col("score") - F.col("gold"))).alias("mse"))
    c = correlations(test, "score", "gold").select(F.coalesce("pearson", F.lit(0.0)).alias("pearson"), F.coalesce("spearman", F.lit(0.0)).alias("spearman"))
    return c.join(mse).select(*(F.round(x, 6).alias(x) for x in ("pearson", "spearman", "mse")))


# The tasks of the benchmark by type and category, and their languages where those are not English alone.
_CQA = "Android English Gaming Gis Mathematica Physics Programmers Stats Tex Unix Webmasters Wordpress"
_RETRIEVAL_S2P = f"{' '.join(f'CQADupstack{x}Retrieval' for x in _CQA.split())} ClimateFEVER DBPedia FEVER FiQA2018 HotpotQA MSMARCO MSMARCOv2 NFCorpus NQ SCIDOCS SciFact TRECCOVID Touche2020"
CATALOG = [
    ("BitextMining", "s2s", "f1", "BUCC Tatoeba"),
    ("Classification", "s2s", "accuracy", "AmazonCounterfactualClassification AmazonReviewsClassification Banking77Classification EmotionClassification MTOPDomainClassification MTOPIntentClassification MassiveIntentClassification MassiveScenarioClassification ToxicConversationsClassification TweetSentimentExtractionClassification"),
    ("Classification", "p2p", "accuracy", "AmazonPolarityClassification ImdbClassification"),
    ("Clustering", "p2p", "v_measure", "ArxivClusteringP2P BiorxivClusteringP2P MedrxivClusteringP2P RedditClusteringP2P StackExchangeClusteringP2P"),
    ("Clustering", "s2s", "v_measure", "ArxivClusteringS2S BiorxivClusteringS2S MedrxivClusteringS2S RedditClustering StackExchangeClustering TwentyNewsgroupsClustering"),
    ("PairClassification", "s2s", "ap", "SprintDuplicateQuestions TwitterSemEval2015 TwitterURLCorpus"),
    ("Reranking", "s2s", "map", "AskUbuntuDupQuestions MindSmallReranking SciDocsRR StackOverflowDupQuestions"),
    ("Retrieval", "p2p", "ndcg_at_10", "ArguAna"),
    ("Retrieval", "s2p", "ndcg_at_10", _RETRIEVAL_S2P),
    ("Retrieval", "s2s", "ndcg_at_10", "QuoraRetrieval"),
    ("STS", "s2s", "cosine_spearman", "BIOSSES STS12 STS13 STS14 STS15 STS16 STS17 STSBenchmark SICK-R"),
    ("STS", "p2p", "cosine_spearman", "STS22"),
    ("Summarization", "p2p", "cosine_spearman", "SummEval"),
]
_MTOP = "en de es fr hi th"
_MASSIVE = "af am ar az bn cy da de el en es fa fi fr he hi hu hy id is it ja jv ka km kn ko lv ml mn ms my nb nl pl pt ro ru sl sq sv sw ta te th tl tr ur vi zh-CN zh-TW"
_TATOEBA = (
    "sqi fry kur tur deu nld ron ang ido jav isl slv cym kaz est heb gla mar lat bel pms gle pes nob bul cbk hun uig rus spa hye tel afr mon arz hrv nov gsw nds ukr uzb lit ina lfn zsm ita cmn lvs glg ceb bre ben swg arq kab fra por tat oci pol war aze vie nno cha mhr dan ell amh pam hsb srp epo kzj awa fao mal ile bos cor cat eus yue swe dtp kat jpn csb xho orv ind tuk max swh hin dsb ber tam slk tgl ast mkd khm ces tzl urd ara kor yid fin tha wuu"
)
LANGUAGES = {
    "BUCC": "de-en fr-en ru-en zh-en",
    "Tatoeba": " ".join(f"{x}-eng" for x in _TATOEBA.split()),
    "AmazonCounterfactualClassification": "en de en-ext ja",
    "AmazonReviewsClassification": "en de es fr ja zh",
    "MTOPDomainClassification": _MTOP,
    "MTOPIntentClassification": _MTOP,
    "MassiveIntentClassification": _MASSIVE,
    "MassiveScenarioClassification": _MASSIVE,
    "STS17": "ko-ko ar-ar en-ar en-de en-en en-tr es-en es-es fr-en it-en nl-en",
    "STS22": "en de es pl tr ar ru zh fr de-en es-en it pl-en zh-en es-it de-fr de-pl fr-pl",
}
TASKS = [(name, kind, category, 1, LANGUAGES.get(name, "en").split(), score) for kind, category, score, names in CATALOG for name in names.split()]


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TASKS, "name string, type string, category string, version int, langs array<string>, main_score string")


def task_filter(spark: SparkSession, names=None, types=None, categories=None, least_version: int = 0, langs=None) -> DataFrame:
    """Tasks by type, category, version and language overlap, pairs of the languages included; names override all of
    these, unknown ones raise (P9)."""
    t = tasks(spark)
    if names:
        unknown = sorted(set(names) - {x[0] for x in TASKS})
        if unknown:
            raise ValueError(f"unknown tasks: {unknown}")
        return t.where(F.col("name").isin(*names))
    if types:
        t = t.where(F.col("type").isin(*types))
    if categories:
        t = t.where(F.col("category").isin(*categories))
    if langs:
        asked = [*langs, *(f"{x}-{y}" for x in langs for y in langs)]
        t = t.where(F.arrays_overlap("langs", F.array(*(F.lit(x) for x in asked))))
    return t.where(F.col("version") >= least_version).select("name", "type", "main_score")
