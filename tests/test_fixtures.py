"""Hand-checked fixtures (FIXTURES.md) and properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.operators import evaluation as E
from corpusloom.operators import lexical as L
from corpusloom.operators import pairs as P
from corpusloom.operators import prep as D
from corpusloom.operators import qa as Q
from corpusloom.operators import ranking as R
from corpusloom.operators import sampling as G
from corpusloom.operators import search as S
from corpusloom.shipping import ship
from corpusloom.sources import readers as I


@pytest.fixture(scope="module")
def judged(spark):
    qrels = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 1), ("q2", "c", 1)], "qid string, doc_id string, rel int")
    run = spark.createDataFrame([("q1", "x", 0.9), ("q1", "a", 0.8), ("q1", "b", 0.7), ("q2", "d", 0.6), ("q2", "e", 0.5)], "qid string, doc_id string, score double")
    return run, qrels


def value(df, metric, k=3):
    return df.where((F.col("metric") == metric) & (F.col("k") == k)).first()["value"]


def test_ranking_metrics(judged):
    run, qrels = judged
    trec = R.trec_metrics(run, qrels, [3])
    assert value(trec, "NDCG") == pytest.approx(0.33483, abs=1e-5)
    assert value(trec, "MAP") == pytest.approx(0.29167, abs=1e-5)
    assert value(trec, "Recall") == 0.5
    assert value(trec, "P") == pytest.approx(1 / 3)
    assert value(R.mrr(run, qrels, [3]), "MRR") == 0.25
    assert value(R.recall_cap(run, qrels, [3]), "R_cap") == 0.5
    assert value(R.hole(run, qrels, [3]), "Hole") == 0.5
    assert value(R.accuracy(run, qrels, [3]), "Accuracy") == 0.5
    assert value(R.binary_metrics(run, qrels, [3]), "ndcg") == pytest.approx(0.34671, abs=1e-5)


def test_query_absent_from_run_and_self_match(spark, judged):
    run, qrels = judged
    more = qrels.unionByName(spark.createDataFrame([("q3", "z", 1)], qrels.schema))
    assert value(R.mrr(run, more, [3]), "MRR") == pytest.approx(0.5 / 3)
    assert value(R.trec_metrics(run, more, [3]), "Recall") == 0.5
    own = run.unionByName(spark.createDataFrame([("q1", "q1", 1.0)], run.schema))
    assert R.without_self(own).count() == run.count()
    with pytest.raises(ValueError):
        R.custom("nope", run, qrels, [1])


def test_bm25(spark):
    docs = spark.createDataFrame([("d1", "a a b"), ("d2", "b c"), ("d3", "c c c d")], "doc_id string, text string")
    ix = L.index(docs)
    q = spark.createDataFrame([(1, "a"), (2, "a a")], "qid int, text string")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in L.okapi(ix, q).collect()}
    assert got[1, "d1"] == pytest.approx(0.70238, abs=1e-5) and got[2, "d1"] == pytest.approx(2 * 0.70238, abs=5e-5)
    plus = {(r["qid"], r["doc_id"]): r for r in L.bm25_plus(ix, q).collect()}
    assert plus[1, "d1"]["score"] == pytest.approx(3.29245, abs=1e-4) and plus[1, "d1"]["constant"] == pytest.approx(1.38629, abs=1e-5)


def test_keyed_dedup(spark):
    rows = spark.createDataFrame([(1, "T\n\nA\nB\nC1"), (2, "U"), (3, "T\nA\nB\nC2"), (4, " ")], "doc_id int, text string")
    got = sorted((r["first_seq"], r["doc_id"]) for r in D.keyed_dedup(rows).collect())
    assert got == [(1, 3), (2, 2)]
    again = D.keyed_dedup(D.keyed_dedup(rows).drop("first_seq"))
    assert sorted(r["doc_id"] for r in again.collect()) == [2, 3]


def test_has_answer(spark):
    text = "The U.S. capital, Washington D.C."
    rows = spark.createDataFrame([("washington d.c",), ("wash",), ("capital washington",), ("",)], "a string")
    got = [r[0] for r in rows.select(T.contains_tokens(F.lit(text), F.col("a"))).collect()]
    assert got == [True, False, False, True]
    assert spark.range(1).select(T.contains_tokens(F.lit(None).cast("string"), F.lit("a"))).first()[0] is False
    one = spark.createDataFrame([(text, ["("]), (text, ["(", "capit.l"])], "t string, a array<string>")
    assert [r[0] for r in one.select(Q.regex_matched(F.col("t"), F.col("a"))).collect()] == [False, True]


def test_answers_and_f1(spark):
    row = spark.range(1).select(T.normalize_answer(F.lit("The cat, sat!")), Q.overlap_f1(F.lit("a cat sat"), F.lit("the cat cat")), Q.exact_match(F.lit("The cat"), F.lit("cat"))).first()
    assert tuple(row) == ("cat sat", 0.5, 1.0)


def test_unicode_normalize(spark):
    got = spark.range(1).select(*(T.normalize_unicode(F.lit(x)) for x in ("“a–b” …", "x″", "a­b", "a\x0bb", "a\x85b"))).first()
    assert tuple(got) == ('"a-b" ...', "x''", "ab", "a b", "a b")


def test_sections_and_titles(spark):
    text = "Head\nBody one\n\nPlain block\n\nSee also\nx\n\nMore"
    got = spark.range(1).select(T.wiki_sections(F.lit(text)).alias("s")).first()["s"]
    assert [(x["header"], x["body"]) for x in got] == [("Head", "Body one"), (None, "Plain block")]
    row = spark.range(1).select(T.title_of(F.lit("\n a b\nc d e f")), T.title_of(F.lit("\n a b\nc d e f"), F.lit("Wikipedia")), T.title_v2(F.lit("Abstract: A title of some length\nbody")), T.title_v2(F.lit("one two"))).first()
    assert tuple(row) == ("c d e f", "a b", "A title of some length", "one")


def test_crop_bounds(spark):
    rows = spark.range(200).withColumn("w", F.array(*(F.lit(str(i)) for i in range(10))))
    for r in rows.select(G.crop(F.col("w"), 1, F.col("id"), 0.05, 0.5, 4, 64).alias("c")).collect():
        assert 4 <= len(r["c"]) <= 5 and r["c"] == [str(i) for i in range(int(r["c"][0]), int(r["c"][0]) + len(r["c"]))]
    whole = rows.limit(3).select(G.crop(F.col("w"), 1, F.col("id"), 0.05, 32, 4, 64, crop_to_maxlen=True).alias("c")).collect()
    assert all(len(r["c"]) == 10 for r in whole)


def test_pair_classification(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.1, 0)], "pair_id int, score double, label int")
    r = P.pair_classification(rows).first()
    assert (r["accuracy"], r["accuracy_threshold"]) == (0.75, pytest.approx(0.85))
    assert (r["f1"], r["f1_threshold"]) == (pytest.approx(0.8), pytest.approx(0.4)) and r["ap"] == pytest.approx(0.83333, abs=1e-5)


def test_spearman_ties_and_constants(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (2.0, 2.0), (4.0, 4.0)], "x double, y double")
    assert P.correlations(rows, "x", "y").first()["spearman"] == pytest.approx(0.94868, abs=1e-5)
    assert P.correlations(rows.withColumn("y", F.lit(1.0)), "x", "y").first()["pearson"] is None


def test_interleave(spark):
    parts = [spark.range(n).select((F.col("id") + at).alias("i")) for n, at in ((3, 0), (4, 3), (5, 7))]
    got = [r["i"] for r in G.interleave(parts, "i").orderBy("position").collect()]
    assert got == [0, 3, 7, 1, 4, 8, 2, 5, 9]


def test_recall_curve(spark):
    first = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "qid int, first int")
    assert [round(r["recall"], 4) for r in Q.hit_curve(first, 4).orderBy("k").collect()] == [0.3333, 0.3333, 0.6667, 0.6667]


def test_markup():
    got = markup.parse("'''Bold''' and [[Cat|cats]] and [[Dog]]s")
    assert got["text"] == "Bold and cats and Dogs" and got["fonts"] == ["Bold"] and set(got["anchors"]) == {"cats", "Dog"}
    assert markup.parse("[[a|b [[c|d]]]]")["text"] == "b d" and markup.parse("[[open")["text"] == "[[open" and markup.parse(None)["text"] is None


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(V.norm(a), V.cosine(a, b), V.euclidean(a, b), V.manhattan(a, b), V.hamming(V.bits(a), V.bits(b))).first()
    assert tuple(row) == (5.0, 0.0, 5.0, 7.0, 2)


def test_exact_search_blocks_agree(spark, monkeypatch):
    ship(spark)
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q, c = e.where("vec_id < 20").withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "doc_id")
    one = sorted(map(tuple, S.exact_search(q, c, 3, exclude_self=True).select("qid", "doc_id", "rank").collect()))
    monkeypatch.setattr(S, "_query_blocks", lambda queries, dims_bytes=0, f=S._query_blocks: f(queries, 4096))
    assert sorted(map(tuple, S.exact_search(q, c, 3, exclude_self=True).select("qid", "doc_id", "rank").collect())) == one
    assert S.exact_search(q.limit(0), c, 3).count() == 0


def test_literals_are_not_evaluated(spark):
    rows = spark.createDataFrame([("['a', \"b'c\"]",), ("__import__('os')",), ("3",), (None,)], "x string")
    assert [r[0] for r in rows.select(I.parse_list(F.col("x"))).collect()] == [["a", "b'c"], None, None, None]


def test_readers_refuse_unknown_files(spark):
    with pytest.raises(ValueError):
        I.by_extension(spark, "x.bin")
    with pytest.raises(ValueError):
        E.task_filter(spark, names=["nothing"])





@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab. é 　\x1c\x85\n\t,", max_size=30), min_size=1, max_size=30))
def test_words_are_python_words(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", T.words("t").alias("w"), T.regex_tokens("t").alias("x")).collect():
        assert r["w"] == r["t"].split()
        assert all(re.search(r"\s", x) is None for x in r["x"])
