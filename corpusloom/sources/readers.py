"""Readers with declared schemas. Optional columns that a file lacks come out as typed nulls. All paths are
Spark paths, so any file system that Spark knows will do."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = "_id string, title string, text string"
QUERIES = "_id string, text string"
QRELS = "`query-id` string, `corpus-id` string, score int"
PASSAGES = "id string, text string, title string"
RECORD = "id string, text string, title string, url string, meta struct<pile_set_name:string>, font_phrases array<string>, anchor_phrases array<string>, categories array<string>, seealso array<string>, outputs map<string,string>"
CTX = "array<struct<title:string,text:string,passage_id:string,score:double>>"
DPR = f"dataset string, question_id string, question string, answers array<string>, positive_ctxs {CTX}, negative_ctxs {CTX}, hard_negative_ctxs {CTX}"
_SIDE = "struct<prompt:string,text:string>"
MEDI = f"query {_SIDE}, pos {_SIDE}, neg {_SIDE}"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSONL corpus: doc_id, title, text (S3)."""
    return spark.read.schema(CORPUS).json(path).select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated judgements with a header (S4). Of repeated pairs the last row of the last file stays."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("place")
    rows = spark.read.schema(QRELS).csv(path, sep="\t", header=True).select("*", place)
    return rows.groupBy(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id")).agg(F.max_by("score", "place").alias("rel"))


def beir(spark: SparkSession, folder: str, split: str = "test", prefix: str | None = None, corpus_file: str = "corpus.jsonl", query_file: str = "queries.jsonl", qrels_folder: str = "qrels", strict: bool = False):
    """(corpus, queries, qrels) of a benchmark folder; queries are those with judgements (S1). prefix renames the
    query file and the judgement folder. strict: judgements of unknown queries raise."""
    if prefix:
        query_file, qrels_folder = f"{prefix}-{query_file}", f"{prefix}-{qrels_folder}"
    return custom(spark, f"{folder}/{corpus_file}", f"{folder}/{query_file}", f"{folder}/{qrels_folder}/{split}.tsv", strict)


def custom(spark: SparkSession, corpus_path: str, query_path: str, qrels_path: str, strict: bool = False):
    """As beir, by explicit paths."""
    rel = qrels(spark, qrels_path)
    queries = spark.read.schema(QUERIES).json(query_path).select(F.col("_id").alias("qid"), "text")
    if strict and not rel.join(queries, "qid", "left_anti").isEmpty():
        raise ValueError("judgements name queries that the query file lacks")
    return corpus(spark, corpus_path), queries.join(rel.select("qid").distinct(), "qid", "left_semi"), rel


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Passages as TSV (header dropped) or JSONL, gzip or not."""
    if ".json" in path:
        return spark.read.schema(PASSAGES).json(path)
    return spark.read.schema(PASSAGES).csv(path, sep="\t", quote='"', escape='"').where("id <> 'id'")


def parse_list(literal):
    """A Python list literal of strings as an array; anything else is null. Nothing is evaluated."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        import ast

        def one(x):
            try:
                v = ast.literal_eval(x)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None
            return [str(i) for i in v] if isinstance(v, (list, tuple)) else None

        return texts.map(one)

    return run(literal)


def stem() -> F.Column:
    """Data set name of a file: its stem with dots as dashes."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return F.translate(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", ""), ".", "-")


def qa(spark: SparkSession, paths: str) -> DataFrame:
    """Question sets of comma-separated globs: dataset, question, answers, entity."""
    out = None
    for path in paths.split(","):
        if path.rstrip("/").endswith(".json"):
            rows = spark.read.schema("question string, answers array<string>, entity string").option("multiLine", True).json(path).select(stem().alias("dataset"), "question", "answers", "entity")
        elif path.rstrip("/").endswith(".jsonl"):
            rows = spark.read.schema("question string, answers array<string>, entity string").json(path).select(stem().alias("dataset"), "question", "answers", "entity")
        else:
            raw = spark.read.schema("question string, answers string").csv(path, sep="\t", quote='"', escape='"').select(stem().alias("dataset"), "question", "answers")
            rows = raw.select("dataset", "question", parse_list(F.col("answers")).alias("answers"), F.lit(None).cast("string").alias("entity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def by_extension(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """json (array), jsonl, csv or tsv (S10, S12, S13); others raise."""
    name = path.rstrip("/").removesuffix(".gz")
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if name.endswith(".jsonl"):
        return reader.json(path)
    if name.endswith((".csv", ".tsv")):
        return reader.csv(path, sep="\t" if name.endswith(".tsv") else ",", header=True, quote='"', escape='"')
    raise ValueError(f"unknown kind of file: {path}")


#: Where a named source keeps its title and text (S11). Files are local; nothing is downloaded.
NAMED = {"c4": (None, "text"), "wiki": ("title", "text"), "wiki-dpr": ("title", "text"), "pile": (None, "text"), "owt2": ("title", "text"), "pmc": (None, "text"), "stackex": (None, "text"), "books3": ("title", "text")}


def named(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A corpus by source name: doc fields id, title, text, meta (S11). beir_* are JSONL corpora, pile_* one subset
    of the pile; other names are paths: JSON, or else lines of text."""
    if name.startswith("beir_"):
        return corpus(spark, path).select(F.col("doc_id").alias("id"), "title", "text")
    rows = spark.read.schema(RECORD).json(path) if name in NAMED or name.startswith("pile_") or path.endswith((".json", ".jsonl")) else spark.read.text(path).select(F.col("value").alias("text"))
    if name.startswith("pile_"):
        rows = rows.where(F.col("meta.pile_set_name") == name.removeprefix("pile_"))
    title, text = NAMED.get(name, (None, "text"))
    have = rows.columns
    col = lambda c: F.col(c) if c and c in have else F.lit(None).cast("string")
    return rows.select(col("id").alias("id"), col(title).alias("title"), F.col(text).alias("text"))


def dpr_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DPR).option("multiLine", path.rstrip("/").endswith(".json")).json(path)


def medi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEDI).json(path)


def embeddings(spark: SparkSession, glob: str) -> DataFrame:
    """Embedding shards (S15): id, embedding."""
    return spark.read.schema("id string, embedding array<float>").parquet(glob)


def token_shards(spark: SparkSession, folder: str, mode: str = "full", rank: int = 0, world: int = 1, schema: str = "id bigint, tokens array<int>", folders: bool = False) -> DataFrame:
    """Token shards below a folder in the order of their paths (S16): all of them, the first alone ("single"), or one rank's
    share ("split": contiguous, the first ranks get one more). Only the names of files are looked at to choose.
    A shard is a file, or with folders the files of one folder, so it can be written by many tasks."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.p*").load(folder).select("path")
    parts: dict[str, list[str]] = {}
    for path in sorted(r["path"] for r in names.collect()):
        parts.setdefault(path.rsplit("/", 1)[0] if folders else path, []).append(path)
    files = sorted(parts)
    if mode == "split":
        size, more = divmod(len(files), world)
        at = rank * size + min(rank, more)
        files = files[at : at + size + (rank < more)]
    elif mode == "single":
        files = files[:1]
    elif mode != "full":
        raise ValueError(f"no such mode: {mode}; one of full, single, split")
    chosen = [path for x in files for path in parts[x]]
    return spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)


def shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of all files below a folder, with their file."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder).withColumn("shard", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1))


def json_array(spark: SparkSession, path: str, item: str) -> DataFrame:
    """A JSON array, or an object with the array under "data" (S18). item: the schema of one element."""
    whole = spark.read.text(path, wholetext=True)
    fields = T._parse_datatype_string(item)
    either = F.coalesce(F.from_json("value", T.ArrayType(fields), {"mode": "PERMISSIVE"}), F.from_json("value", T.StructType([T.StructField("data", T.ArrayType(fields))]))["data"])
    is_object = F.trim(F.col("value")).startswith("{")
    data = F.when(is_object, F.from_json("value", T.StructType([T.StructField("data", T.ArrayType(fields))]))["data"]).otherwise(either)
    return whole.select(F.explode(data).alias("x")).select("x.*")


def _lined(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of one file numbered from 0: the file is one text, so order is certain."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", name))
    return lines


def sts_pairs(spark: SparkSession, pairs_path: str, gold_path: str) -> DataFrame:
    """Pairs by tab and line-aligned gold scores; blank scores go with their pair."""
    pairs = _lined(spark, pairs_path, "pair").withColumn("p", F.split("pair", "\t"))
    rows = pairs.join(_lined(spark, gold_path, "gold"), "line").where(F.trim("gold") != "")
    return rows.select(F.col("line").cast("bigint").alias("line"), F.get("p", F.lit(0)).alias("s1"), F.get("p", F.lit(1)).alias("s2"), F.trim("gold").cast("double").alias("gold"))


def columns(spark: SparkSession, path: str, places: dict[str, int], header: bool = False) -> DataFrame:
    """Chosen columns of a tab-separated file by place from 0: STS-B has score, s1, s2 at 4, 5, 6; SICK 1, 2, 3 with a header."""
    n = max(places.values()) + 1
    schema = ", ".join(f"c{i} string" for i in range(n))
    rows = spark.read.schema(schema).csv(path, sep="\t", header=header, quote="")
    return rows.select(*(F.col(f"c{i}").alias(name) for name, i in places.items()))


def probing(spark: SparkSession, path: str) -> DataFrame:
    """split, label, text of a probing file; the text is the last column."""
    names = F.create_map(*(F.lit(x) for x in ("tr", "train", "va", "dev", "te", "test")))
    p = F.split("value", "\t")
    return spark.read.text(path).select(names[F.get(p, F.lit(0))].alias("split"), F.get(p, F.lit(1)).alias("label"), F.element_at(p, -1).alias("text"))


def recall_files(spark: SparkSession, glob: str) -> DataFrame:
    """dataset (the file's folder), k, recall of recall_at_k.csv files."""
    rows = spark.read.schema("k int, recall double").csv(glob, header=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/?[^/]*$", 1).alias("dataset"), "k", "recall")


def score_files(spark: SparkSession, glob: str) -> DataFrame:
    """dataset, split, metric, k, value of result files with a scores map of maps."""
    rows = spark.read.schema("dataset string, split string, metric string, scores map<string,map<string,double>>").json(glob)
    rows = rows.select("dataset", "split", F.explode("scores").alias("family", "m")).select("dataset", "split", F.explode("m").alias("key", "value"))
    return rows.select("dataset", "split", F.substring_index("key", "@", 1).alias("metric"), F.substring_index("key", "@", -1).cast("int").alias("k"), "value")


def per_language(spark: SparkSession, path: str, langs: list[str] | None = None) -> DataFrame:
    """A table partitioned by lang, only the partitions asked for."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("lang").isin(*langs)) if langs else rows


def lookup(*parts: DataFrame) -> DataFrame:
    """Several tables as one, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
