"""Queries on a BM25 search shuffle terms and first rows, not rows of a query and a document."""

import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import catalog

ROOT = "/root/testdata"


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Few documents with the 200 items that the larger tables have."""
    out = tmp_path_factory.mktemp("growth")
    for name, sf in (("documents", "sf0.01"), ("benchmark", "sf0.1")):
        shutil.copy(f"{ROOT}/{sf}/{name}.parquet", out / f"{name}.parquet")
    return str(out)


def shuffled(spark, run):
    """Bytes that stages write for a shuffle while run() goes on."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        none, numbers = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, numbers, none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = total()
    run()
    return sum(n for at, n in total().items() if at not in before)


@pytest.mark.parametrize(
    "name",
    [
        "A16_bm25_plus",
        "A16_bm25_l",
        "A10_V21_hit_curve",
        "A11_macro_recall",
        "F14_has_answer",
        "F14_regex_answer",
        "K1_W6_nested_results",
        "K2_recall_curve",
    ],
)
def test_less_than_the_texts_is_shuffled(name, spark, tables):
    size = spark.read.parquet(f"{tables}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < shuffled(spark, lambda: catalog.queries()[name](spark, tables).collect()) < size
