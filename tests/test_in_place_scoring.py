"""Documents are scored where their rows lie: no pair of query and document is shuffled, and the results stay whole."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.operators import lexical as L
from corpusloom.operators import ranking as R


def texts(seed, n, words):
    r = random.Random(seed)
    return [" ".join(f"w{int(r.paretovariate(0.4)) % 97}" for _ in range(r.randint(0, words))) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


def test_only_the_best_rows_leave_a_task(spark):
    rows = [*enumerate(texts(1, 900, 30)), (5, "w1 w2 w3"), (5, "w1 w1"), (7, None), (901, ""), *((1000 + i, "w1 w3 w5") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts(2, 20, 9))], "qid bigint, text string")
    ix = L.index(docs)
    for search in (L.okapi, L.bm25_l, L.bm25_plus):
        every = defaultdict(list)
        for r in search(ix, queries).collect():
            every[r["qid"]].append((-r["score"], r["doc_id"]))
        best = search(ix, queries, k=10)
        assert best.count() < 20 * (10 * 4 + 12) < sum(map(len, every.values()))
        got = {(r["qid"], r["rank"]): (-r["score"], r["doc_id"]) for r in R.ranked(best, 10).collect()}
        assert got == {(q, i + 1): x for q, v in every.items() for i, x in enumerate(sorted(v)[:10])}
        assert max(len({d for _, d in v}) for v in every.values()) == max(map(len, every.values()))


def test_chunks_of_a_document_meet_before_they_are_scored(spark):
    long = texts(3, 700, 5)
    rows = [(1, i, t) for i, t in enumerate(long)] + [(2, i, t) for i, t in enumerate(long[:300])] + [(d, i, t) for d in range(3, 40) for i, t in enumerate(texts(d, 4, 6))] + [(2, 5, "w1 w2")]
    chunks = spark.createDataFrame(rows, "doc_id bigint, chunk_id bigint, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts(4, 900, 7))], "qid bigint, text string")
    found = L.best_chunk(chunks, queries)
    assert "hashpartitioning(qid" not in plan(found) and "hashpartitioning(doc_id" in plan(found)
    want = {}
    scores = L.okapi(L.index(chunks.select(F.struct("doc_id", "chunk_id").alias("doc_id"), "text")), queries)
    for r in scores.select("qid", "doc_id.doc_id", "doc_id.chunk_id", "score").collect():
        x = (-r["score"], r["chunk_id"])
        want[r["qid"], r["doc_id"]] = min(want.get((r["qid"], r["doc_id"]), x), x)
    got = {(r["qid"], r["doc_id"]): (-r["score"], r["chunk_id"]) for r in found.collect()}
    assert set(got) == set(want)
    wrong = [k for k in want if got[k][1] != want[k][1] or abs(got[k][0] - want[k][0]) > 2e-9]
    assert not wrong


def test_fields_meet_before_they_are_scored(spark):
    rows = [*enumerate(texts(5, 400, 12)), (3, "w1 w2"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    first = docs.select("doc_id", F.substring_index("text", " ", 3).alias("text"))
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts(6, 30, 9))], "qid bigint, text string")
    indexes = [L.index(first), L.index(docs)]
    both = defaultdict(list)
    for ix in indexes:
        for r in L.okapi(ix, queries).collect():
            both[r["qid"], r["doc_id"]].append(r["score"])
    want = {k: max(v) + 0.5 * (sum(v) - max(v)) for k, v in both.items()}
    whole = L.best_fields(indexes, queries)
    assert "hashpartitioning(qid" not in plan(whole)
    got = {(r["qid"], r["doc_id"]): r["score"] for r in whole.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    first7 = {(r["qid"], r["doc_id"]) for r in R.ranked(L.best_fields(indexes, queries, k=7), 7).collect()}
    assert first7 == {(r["qid"], r["doc_id"]) for r in R.ranked(whole, 7).collect()}
