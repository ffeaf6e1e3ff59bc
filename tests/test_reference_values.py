"""Values that must equal the surveyed behaviour, and metrics against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.functions.rand import uniform
from corpusloom.operators import evaluation as E
from corpusloom.operators import pairs as P
from corpusloom.operators import qa as Q
from corpusloom.operators import sampling as G
from corpusloom.operators import search as S
from corpusloom.sources import readers

SF = "/root/testdata/sf0.001"


def test_every_character_of_the_table(spark):
    becomes = {c: "" for c in (*range(0x01, 0x09), 0x0E, 0x0F, *range(0x11, 0x1C), 0xAD)}
    becomes |= dict.fromkeys((0x0B, 0x0C, 0x85), " ") | dict.fromkeys((*range(0x2010, 0x2016), 0x2043, 0x2212, 0xFF0D, 0x207B), "-")
    becomes |= dict.fromkeys(range(0x201C, 0x2020), '"') | dict.fromkeys((0x2018, 0x2019, 0x201A, 0x201B, 0x55A, 0xA78B, 0xA78C, 0xFF07, 0x60, 0xB4, 0x2032, 0x2035), "'")
    becomes |= dict.fromkeys((0x2033, 0x2036), "''") | dict.fromkeys((0x2034, 0x2037), "'''") | {0x2057: "''''", 0x2026: "..."} | dict.fromkeys((0x2044, 0x2215), "/")
    every = [c for c in (*range(0x00, 0x180), *range(0x2000, 0x2100), *range(0x2200, 0x2240), 0x55A, 0x2BC, 0x2B9, 0xA78B, 0xA78C, *range(0xFE60, 0xFE65), *range(0xFF00, 0xFF20))]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in every], "c int, t string").select("c", T.normalize_unicode("t").alias("t")).collect()
    for r in rows:
        assert r["t"] == f"a{becomes.get(r['c'], chr(r['c']))}b", hex(r["c"])


def test_answers_match_composed_and_decomposed(spark):
    rows = [("un café noir", ["café"]), ("un café noir", ["café"]), ("un cafe noir", ["café"]), (None, ["x"])]
    run = spark.createDataFrame([(i, i, 1.0, 1) for i in range(4)], "qid int, doc_id int, score double, rank int")
    passages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    questions = spark.createDataFrame([(i, a) for i, (_, a) in enumerate(rows)], "qid int, answers array<string>")
    got = {r["qid"]: r["has_answer"] for r in Q.matched(run, passages, questions).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}
    both = spark.createDataFrame(rows[:3], "t string, a array<string>")
    assert [r[0] for r in both.select(Q.regex_matched(F.col("t"), F.col("a"))).collect()] == [True, True, False]


def test_last_judgement_wins(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t2\n1\tb\t1\n1\ta\t0\n")
    assert {tuple(r) for r in readers.qrels(spark, str(tmp_path / "q.tsv")).collect()} == {("1", "a", 0), ("1", "b", 1)}


def test_task_catalog(spark):
    assert len(E.TASKS) == len({t[0] for t in E.TASKS}) == 70
    counts = {r["type"]: r["count"] for r in E.tasks(spark).groupBy("type").count().collect()}
    assert counts == {"BitextMining": 2, "Classification": 12, "Clustering": 11, "PairClassification": 3, "Reranking": 4, "Retrieval": 27, "STS": 10, "Summarization": 1}
    assert {r["name"] for r in E.task_filter(spark, langs=["fr", "en"], types=["STS"], categories=["p2p"]).collect()} == {"STS22"}
    assert {r["name"] for r in E.task_filter(spark, langs=["de", "en"], types=["BitextMining"]).collect()} == {"BUCC"}


def test_bytes_that_are_no_text(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xffb\xef\xbf\xbdc"),), (bytearray("d�".encode()),)], "b binary").select(F.col("b").cast("string").alias("t"))
    assert [r[0] for r in rows.select(T.utf8("t")).collect()] == ["ab�c", "d�"]


# --- models against numpy ----------------------------------------------------------------------
def softmax_fit(x, y, k, penalty, steps=4000, rate=1.0):
    """Multinomial logistic regression by gradient descent; intercepts are not penalised."""
    w, b, one = np.zeros((x.shape[1], k)), np.zeros(k), np.eye(k)[y]
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= rate * (x.T @ (p - one) / len(x) + penalty * w)
        b -= rate * (p - one).mean(0)
    return lambda t: (t @ w + b).argmax(1)


def vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 300")
    return e.withColumn("label", F.col("label") % 3)


def test_logistic_accuracy_equals_numpy(spark):
    e = vectors(spark)
    got = E.logistic_experiments(e, 2, 30, penalty=0.05).first()
    want = []
    for i in range(2):
        train = G.undersample(e.where("vec_id % 5 <> 0"), "label", 30, 11 + i, "vec_id").toPandas()
        test = e.where("vec_id % 5 = 0").toPandas()
        f = softmax_fit(np.stack(train["embedding"]).astype(float), train["label"].to_numpy(), 3, 0.05)
        want.append((f(np.stack(test["embedding"]).astype(float)) == test["label"].to_numpy()).mean())
    assert abs(got["accuracy"] - np.mean(want)) < 0.02 and abs(got["accuracy_stderr"] - np.std(want)) < 0.02 and got["n_experiments"] == 2


def test_folds_equal_numpy(spark):
    e, grid = vectors(spark), (0.01, 1.0)
    x = e.withColumn("fold", F.floor(uniform(5, F.col("vec_id")) * 3)).toPandas()
    a, y, fold = np.stack(x["embedding"]).astype(float), x["label"].to_numpy(), x["fold"].to_numpy()
    score = lambda tr, te, p: (softmax_fit(a[tr], y[tr], 3, p, 1500)(a[te]) == y[te]).mean()
    for r in E.nested_folds(e, 3, grid).collect():
        k = r["fold"]
        inner = [f for f in range(3) if f != k]
        means = [np.mean([score((fold != k) & (fold != f), fold == f, p) for f in inner]) for p in grid]
        assert abs(r["dev_accuracy"] - means[grid.index(r["penalty"])]) < 0.03
        assert abs(r["test_accuracy"] - score(fold != k, fold == k, r["penalty"])) < 0.03
    one = E.split_test(e.where("vec_id % 4 > 1"), e.where("vec_id % 4 = 1"), e.where("vec_id % 4 = 0"), grid).first()
    m = x["vec_id"].to_numpy() % 4
    assert abs(one["test_accuracy"] - score(m > 1, m == 0, one["penalty"])) < 0.03


def test_relatedness_equals_ridge(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    got = E.relatedness(spark.read.parquet(f"{SF}/embeddings.parquet")).first()
    v = {r.vec_id: (np.array(r.embedding, float), r.label) for r in e.itertuples()}
    ids = [i for i in v if i + 1 in v]
    x = np.array([np.concatenate((np.abs(v[i][0] - v[i + 1][0]), v[i][0] * v[i + 1][0])) for i in ids])
    gold = np.array([1 + abs(v[i][1] - v[i + 1][1]) * 4 / 9.0 for i in ids])
    low = np.floor(gold)
    soft = np.stack([np.where(low == k, low + 1 - gold, np.where(low + 1 == k, gold - low, 0)) for k in range(1, 6)], 1)
    train = np.array([i % 3 != 0 for i in ids])
    xm, sm = x[train].mean(0), soft[train].mean(0)
    cov, cross = (x[train] - xm).T @ (x[train] - xm) / train.sum(), (x[train] - xm).T @ (soft[train] - sm) / train.sum()
    # the library's penalty is relative to the deviation of what is fitted
    w = np.stack([np.linalg.solve(cov + 0.1 / soft[train][:, k].std(ddof=1) * np.eye(x.shape[1]), cross[:, k]) for k in range(5)], 1)
    score = ((x[~train] - xm) @ w + sm) @ np.arange(1, 6)
    assert abs(got["mse"] - ((score - gold[~train]) ** 2).mean()) < 1e-4
    assert abs(got["pearson"] - np.corrcoef(score, gold[~train])[0, 1]) < 1e-3


# --- bounded tasks -----------------------------------------------------------------------------
def test_search_in_small_tiles_and_blocks(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q, c = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "doc_id")
    x = e.orderBy("vec_id").toPandas()
    a = np.stack(x["embedding"]).astype(float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    s = np.round(a @ a.T, 9)
    np.fill_diagonal(s, -9)
    want = {(i, j) for i in range(0, len(a), 20) for j in sorted(range(len(a)), key=lambda j: (-s[i, j], j))[:7]}
    monkeypatch.setattr(S, "ROW_TILE", 16)
    monkeypatch.setattr(S, "QUERY_TILE", 3)
    monkeypatch.setattr(S, "QUERY_BYTES", 4096)
    got = S.exact_search(q, c, 7, exclude_self=True).collect()
    assert {(r["qid"], r["doc_id"]) for r in got} == want


def test_ranks_and_cuts_over_ranges(spark):
    r = np.random.default_rng(4)
    x = pd.DataFrame({"pair_id": range(500), "score": r.integers(0, 40, 500) / 10, "label": r.integers(0, 2, 500), "g": r.integers(0, 3, 500)})
    rows = spark.createDataFrame(x)
    got = {k["pair_id"]: k["r"] for k in P.average_ranks(rows, "score", "r").collect()}
    assert got == dict(zip(x["pair_id"], x["score"].rank(), strict=True))
    got = {k["pair_id"]: k["r"] for k in P.average_ranks(rows, "score", "r", ["g"]).collect()}
    assert got == dict(zip(x["pair_id"], x.groupby("g")["score"].rank(), strict=True))
    o = x.sort_values(["score", "pair_id"], ascending=[False, True])
    tp, i, n, pos = o["label"].cumsum().to_numpy(), np.arange(1, 501), 500, x["label"].sum()
    acc = (tp + (n - pos) - (i - tp))[:-1] / n
    best = P.pair_classification(rows).first()
    s = o["score"].to_numpy()
    assert best["accuracy"] == acc.max() and best["accuracy_threshold"] == (s[acc.argmax()] + s[acc.argmax() + 1]) / 2


def test_plans_hold_no_nested_loop_over_two_tables(spark):
    from corpusloom.plans import catalog

    for name in ("V10_binary_search", "J1_J13_pairs", "J16_pairwise_negatives", "A25_reranking"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        loops = [x for x in plan.split("\n") if "NestedLoopJoin" in x or "CartesianProduct" in x]
        assert not loops, (name, loops)


def test_pair_features_are_symmetric(spark):
    f = spark.range(1).select(V.pair_features(F.array(F.lit(1.0), F.lit(-2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("f")).first()["f"]
    assert f == [2.0, 6.0, 3.0, -8.0]
