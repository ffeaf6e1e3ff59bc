"""Queries on a BM25 search equal their SQL where texts are null or empty: a null text is a document without a length."""

import duckdb
import pytest

from corpusloom.plans import catalog

from test_queries import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    out, duck = tmp_path_factory.mktemp("nulls"), duckdb.connect()
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        text = f"case {key} % 9 when 4 then null when 5 then '' else text end as text"
        duck.execute(f"copy (select * replace ({text}) from '{SF}/{name}.parquet') to '{out}/{name}.parquet' (format parquet)")
        duck.execute(f"create view {name} as select * from '{out}/{name}.parquet'")
    return str(out), duck


@pytest.mark.parametrize(
    "name",
    [
        "A13_corpus_stats",
        "A16_bm25_plus",
        "A16_bm25_l",
        "A10_V21_hit_curve",
        "A11_macro_recall",
        "F14_has_answer",
        "F14_regex_answer",
        "K1_W6_nested_results",
        "K2_recall_curve",
        "A46_rescored",
        "A15_V12_okapi_top10",
        "A17_subset_scores",
        "V13_two_fields_page",
    ],
)
def test_equals_its_sql(name, spark, tables):
    path, duck = tables
    df, want = catalog.queries()[name](spark, path), duck.sql(catalog.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
