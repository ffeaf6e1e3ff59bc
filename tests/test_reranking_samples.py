"""A25 on samples without positives or without negatives, as its SQL counts them."""

import duckdb
import pytest

from corpusloom.operators import pairs as P
from corpusloom.plans import data

SF = "/root/testdata/sf0.01"


def test_samples_of_one_kind(spark):
    rows = [(1, 1, 1, 0.9, 0), (1, 1, 2, 0.8, 1), (2, 1, 1, 0.9, 0), (2, 1, 2, 0.7, 0), (3, 1, 1, 0.5, 1)]
    df = spark.createDataFrame(rows, "sample_id bigint, subquery_id bigint, cand_id bigint, score double, relevant int")
    assert tuple(P.reranking(df, mixed_only=False).first()) == pytest.approx((0.75, 0.5))
    assert tuple(P.reranking(df).first()) == pytest.approx((0.5, 0.5))


def test_query_matches_its_sql_where_a_sample_has_no_positive(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert tuple(data.QUERIES["A25_reranking"](spark, SF).first()) == con.execute(data.SQL["A25_reranking"]).fetchone()
