"""Extension points (U1-U10): what a user of the library may plug in."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vector as V

from . import search as S

#: Column in, array of strings out (U4), as L.index(docs, tokenizer=...) takes it.
Tokenizer = Callable[[Column], Column]
#: Two vector columns in, a score out (U3); named ones are in vector.SCORES.
Scorer = Callable[[Column, Column], Column]


class Encoder(Protocol):
    """Adds an ``embedding`` column."""

    def encode(self, rows: DataFrame) -> DataFrame: ...


class Precomputed:
    """The default encoder: joins a table of embeddings by key."""

    def __init__(self, table: DataFrame, key: str):
        self.table, self.key = table, key

    def encode(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table.select(self.key, "embedding"), self.key)


class Retriever(Protocol):
    """run(qid, doc_id, score, rank) of queries over a corpus (U8)."""

    def search(self, queries: DataFrame, corpus: DataFrame, top_k: int, score: str) -> DataFrame: ...


class ExactRetriever:
    def __init__(self, query_encoder: Encoder | None = None, corpus_encoder: Encoder | None = None):
        self.query_encoder, self.corpus_encoder = query_encoder, corpus_encoder

    def search(self, queries: DataFrame, corpus: DataFrame, top_k: int = 10, score: str = "cos_sim") -> DataFrame:
        q = self.query_encoder.encode(queries) if self.query_encoder else queries
        c = self.corpus_encoder.encode(corpus) if self.corpus_encoder else corpus
        return S.exact_search(q, c, top_k, score, exclude_self=True)


def cross_encoder(predict: Callable[[list[str], list[str]], list[float]]) -> Scorer:
    """A scorer of text pairs from a batch function (U7), for search.rerank_own-like joins over text columns."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(a, b):
        return pd.Series(predict(list(a), list(b)), dtype=float)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return pandas_udf(run, "double")


def scored(pairs: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """pairs(a, b: vectors) with a column for each named scorer."""
    return pairs.select("*", *(fn(V.doubles("a"), V.doubles("b")).alias(name) for name, fn in scorers.items()))


def map_batches(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A lazy map over batches of rows (U1): fn takes and gives a pandas frame."""

    def run(frames):
        for frame in frames:
            yield fn(frame)

    return rows.mapInPandas(run, schema)


class BatchEncoder:
    """An encoder made of two callables (U6): prepare(rows), once, gives what batcher(prepared, texts) needs to make vectors."""

    def __init__(self, prepare: Callable[[DataFrame], object], batcher: Callable[[object, list[str]], list[list[float]]]):
        self.prepare, self.batcher = prepare, batcher

    def encode(self, rows: DataFrame) -> DataFrame:
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        prepared, batcher = self.prepare(rows), self.batcher

        def run(texts):
            return pd.Series(batcher(prepared, list(texts)))

        run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return rows.withColumn("embedding", pandas_udf(run, "array<double>")("text"))


def generate(corpus: DataFrame, queries_of: Callable[[Column], Column]) -> DataFrame:
    """n queries per passage (U10): queries_of gives an array of strings."""
    return corpus.select("doc_id", F.explode(queries_of(F.col("text"))).alias("query"))


#: Registered tasks by name.
REGISTRY: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


@register("similarity")
def similarity(rows: DataFrame, score: str = "cos_sim") -> DataFrame:
    return rows.withColumn("score", V.SCORES[score](V.doubles("a"), V.doubles("b")))
