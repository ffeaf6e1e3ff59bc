"""Functions on single texts grow with the text: each text here has tens of thousands of words."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import qa as Q
from corpusloom.operators import sampling as G

WORDS = 30_000


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"{r.choice('abcdefgh')}{int(r.paretovariate(0.3)) % 5000}" for _ in range(WORDS + i))) for i in range(4)]
    return spark.createDataFrame([*rows, (9, ""), (10, "a"), (11, None)], "doc_id bigint, text string").coalesce(1)


def within(seconds, df):
    at = time.time()
    rows = {r["doc_id"]: r["out"] for r in df.collect()}
    assert time.time() - at < seconds
    return rows


def test_ngrams(spark, long):
    got = within(40, long.select("doc_id", T.ngrams(T.words("text"), 2, keep=lambda x: ~F.contains(x, F.lit("e"))).alias("out")))
    for i, text in long.collect():
        w = (text or "").split()
        assert got[i] == (None if text is None else [x for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])] if "e" not in x])


def test_shuffle_some(spark, long):
    got = within(60, long.select("doc_id", G.shuffle_some(T.words("text"), 6, F.col("doc_id"), 0.5).alias("out")))
    for i, text in long.collect():
        w = (text or "").split()
        assert (got[i] is None) if text is None else Counter(got[i]) == Counter(w)
    assert 0.4 < sum(a != b for a, b in zip(got[0], long.first()["text"].split())) / WORDS < 0.55


def test_f1_over_answers(spark, long):
    half = F.array_join(F.slice(T.words("text"), 1, WORDS // 2), " ")
    rows = long.withColumn("gold", half)
    native = within(40, rows.select("doc_id", Q.overlap_f1(F.col("text"), F.col("gold")).alias("out")))
    counted = within(40, rows.select("doc_id", Q.best_overlap_f1(T.normalize_answer("text"), F.array(T.normalize_answer("gold"), F.lit("zz"), F.lit(None))).alias("out")))
    assert native == pytest.approx(counted) and native[9] == 0.0 and native[11] is None
    tokens = [x for x in long.first()["text"].split() if x != "a"]
    half = [x for x in long.first()["text"].split()[: WORDS // 2] if x != "a"]
    assert native[0] == pytest.approx(2 * len(half) / (len(tokens) + len(half)))
