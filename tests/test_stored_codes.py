"""V6: codes are stored, so the search's stage has one Python kernel."""

import random

from corpusloom.operators import search as S


def test_one_kernel_a_stage(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id bigint, embedding array<double>")
    queries, corpus = rows.where("id % 20 = 0").withColumnRenamed("id", "qid"), rows.withColumnRenamed("id", "doc_id")
    found = S.pq_search(queries, corpus, 5, parts=2, codes=8, wide=59)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    best = {(x["qid"], x["rank"]): x["doc_id"] for x in found.collect()}
    want = {(x["qid"], x["rank"]): x["doc_id"] for x in S.exact_search(queries, corpus, 5, "dot", exclude_self=True).collect()}
    assert best == want
