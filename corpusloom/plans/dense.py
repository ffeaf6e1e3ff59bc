"""Dense search and ranking metrics over ``embeddings``: rows whose vec_id is divisible by 100 are queries against all
rows but themselves, equal labels are relevant (even ids with grade 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vector as V
from corpusloom.operators import pairs as P
from corpusloom.operators import ranking as R
from corpusloom.operators import search as S
from corpusloom.operators.prep import dense_ids

KS = [1, 3, 5, 10]


def emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def split(spark, d):
    e = emb(spark, d)
    return e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "doc_id")


def qrels(q, c):
    return q.select("qid", "label").join(c.select("doc_id", "label"), "label").where("qid <> doc_id").select("qid", "doc_id", (F.lit(1) + (F.col("doc_id") % 2 == 0).cast("int")).alias("rel"))


def run_of(spark, d, k=10, score="cos_sim"):
    q, c = split(spark, d)
    return S.exact_search(q, c, k, score, exclude_self=True), qrels(q, c)


def _rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


Q = """
q as (select vec_id as qid, embedding::double[] as e, label from embeddings where vec_id % 100 = 0),
c as (select vec_id as doc_id, embedding::double[] as e, label from embeddings),
qr as (select qid, doc_id, 1 + (doc_id % 2 = 0)::int as rel from q join c on q.label = c.label and qid <> doc_id)"""
COS = "list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e)))"


def sql_run(score=COS, k=10, where="true"):
    return f"""{Q},
s as (select qid, doc_id, round({score}, 9) as score from q, c where q.qid <> c.doc_id and {where}),
run as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s) where rank <= {k}),
j as (select run.*, coalesce(qr.rel, 0) as rel from run left join qr using (qid, doc_id))"""


RUN_OUT = "select qid, doc_id, round(score, 6) as score, cast(rank as bigint) as rank from run"
KV = "(values (1), (3), (5), (10)) ks(k)"


def top(score):
    def q(spark, d):
        return _rounded(run_of(spark, d, 10, score)[0].select("qid", "doc_id", "score", "rank"))

    return q


def metrics(fn):
    def q(spark, d):
        run, rel = run_of(spark, d)
        return _rounded(fn(run, rel, KS))

    return q


def v1(spark, d):
    run, rel = run_of(spark, d)
    every = R.trec_metrics(run, rel, [10]).unionByName(R.mrr(run, rel, [10]))
    return _rounded(R.presented(every.where("metric <> 'P'"), 9))


NQ = "(select count(distinct qid) from qr)"
TREC = f"""
n as (select qid, count(*) as n_rel from qr group by qid),
i as (select qid, k, sum(rel / log2(r + 1)) as ideal from (select *, row_number() over (partition by qid order by rel desc, doc_id) as r from qr), {KV} where r <= k group by qid, k),
h as (select *, sum((rel > 0)::int) over (partition by qid order by rank) as hits from j),
g as (select qid, k, sum(case when rank <= k then rel / log2(rank + 1) else 0 end) as dcg, sum(case when rank <= k and rel > 0 then hits / rank else 0 end) as ap, sum(case when rank <= k and rel > 0 then 1.0 else 0 end) as hit from h, {KV} group by qid, k),
t as (select * from g join n using (qid) join i using (qid, k)),
trec as (select 'NDCG' as metric, k, avg(dcg / ideal) as value from t group by k union all select 'MAP', k, avg(ap / n_rel) from t group by k
union all select 'Recall', k, avg(hit / n_rel) from t group by k union all select 'P', k, avg(hit / k) from t group by k)"""
FIRST = "f as (select qid, min(rank) as first from j where rel > 0 group by qid), fq as (select * from (select distinct qid from qr) left join f using (qid))"
OUT = "select metric, cast(k as bigint) as k, round(cast(value as double), 6) as value from "
MRR = f"{FIRST}, mrr as (select 'MRR' as metric, k, avg(case when first <= k then 1.0 / first else 0 end) as value from fq, {KV} group by k)"


def hybrid_fields(kind):
    """Pairs (vec_id, vec_id + 1) with a score."""

    def q(spark, d):
        e = emb(spark, d)
        a = e.select("vec_id", F.col("embedding").alias("a"), F.col("label").alias("la"))
        b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
        return a.join(b, "vec_id").select("vec_id", "la", "lb", F.round(S.score_pairs(None, "a", "b", kind), 6).alias("score"))

    return q


PAIRS = "p as (select a.vec_id, a.label as la, b.label as lb, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
SCORE_SQL = {
    "cos_sim": "list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))",
    "dot": "list_inner_product(a, b)",
    "euclidean": "-sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i]))))",
    "manhattan": "-list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))",
}


def v2(spark, d):
    q, c = split(spark, d)
    return _rounded(S.exact_search(q, c, 5, "cos_sim", exclude_self=True).select("qid", "doc_id", "score", "rank"))


def p7(spark, d):
    q, c = split(spark, d)
    return _rounded(S.exact_search(q, c, 5, "cos_sim", exclude_self=True, threshold=0.3).select("qid", "doc_id", "score", "rank"))


def v7(spark, d):
    e = emb(spark, d).select("vec_id", F.transform(V.doubles("embedding"), lambda x: x * (F.col("vec_id") % 7 + 1)).alias("embedding"))
    return S.mips(e).select("vec_id", F.round(F.element_at("extended", -1), 6).alias("extra"))


def v8(spark, d):
    q, c = split(spark, d)
    return _rounded(S.exact_search(q, S.half_precision(c), 10, "dot", exclude_self=True).select("qid", "doc_id", "score", "rank"))


def v10(spark, d):
    q, c = split(spark, d)
    return _rounded(S.binary_search(q, c, 10, 50).select("qid", "doc_id", "score", "rank"))


#: The approximate indexes; the tests hold them to 0.9 of the exact first ten.
INDEXES = {
    "V6_pq_recall": lambda q, c: S.pq_search(q, c, 10),
    "V9_pca_recall": lambda q, c: S.pca_search(q, c, 10, 56),
    "V11_ivf_recall": lambda q, c: S.ivf_search(q, c, 10),
}


def measured_recall(approx, spark, d):
    """One row: the share of the exact first ten that the approximate search finds."""
    qs, c = split(spark, d)
    exact = S.exact_search(qs, c, 10, "dot", exclude_self=True).select("qid", "doc_id")
    found = approx(qs, c).select("qid", "doc_id")
    n = exact.join(found.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    return n.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def recall_against_exact(approx):
    """Per query how many of the exact first ten the approximate search finds."""

    def q(spark, d):
        qs, c = split(spark, d)
        exact = S.exact_search(qs, c, 10, "dot", exclude_self=True).select("qid", "doc_id")
        found = approx(qs, c).select("qid", "doc_id").withColumn("hit", F.lit(1))
        return exact.join(found, ["qid", "doc_id"], "left").groupBy("qid").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.count("*").alias("wanted"))

    return q


def j8(spark, d):
    q, c = split(spark, d)
    run = S.exact_search(q, c, 10, "cos_sim", exclude_self=True)
    return _rounded(S.rerank_pool(q, c, run, 3, 5).select("qid", "doc_id", "score", "rank"))


def j9(spark, d):
    q, c = split(spark, d)
    run = S.exact_search(q, c, 10, "cos_sim", exclude_self=True)
    return _rounded(S.rerank_own(run, q, c, 5, V.SCORES["manhattan"]).select("qid", "doc_id", "score", "rank"))


def j16(spark, d):
    """Mean inner product of different vectors of a label: the square of their sum less the sum of their squares, over n (n - 1)."""
    e = emb(spark, d).select("label", "vec_id", V.doubles("embedding").alias("e"))
    sums = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"))
    per = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x")).alias("all"), F.sum("own").alias("own"))
    n = e.groupBy("label").agg((F.count("*") * (F.count("*") - 1)).alias("n")).where("n > 0")
    return per.join(n, "label").select("label", F.round((F.col("all") - F.col("own")) / F.col("n"), 6).alias("mean_negative"), "n")


def k10(spark, d):
    return dense_ids(emb(spark, d), "vec_id")


def a12(spark, d):
    run, rel = run_of(spark, d)
    every = R.trec_metrics(run, rel, KS).unionByName(R.recall_cap(run, rel, KS)).withColumn("dataset", F.lit("one"))
    every = every.unionByName(every.withColumn("dataset", F.lit("trec-covid")).withColumn("value", F.col("value") / 2))
    every = every.unionByName(every.where("dataset = 'one'").withColumn("dataset", F.lit("sub-a"))).unionByName(every.where("dataset = 'one'").withColumn("dataset", F.lit("sub-b")).withColumn("value", F.col("value") / 4))
    return _rounded(R.macro_average(every, groups={"sub-a": "sub", "sub-b": "sub"}))


def a43(spark, d):
    run, rel = run_of(spark, d)
    s = R.trec_metrics(run, rel, [10]).withColumn("dataset", F.lit("x")).unionByName(R.mrr(run, rel, [10]).withColumn("dataset", F.lit("y")))
    return _rounded(R.score_pivot(s, ["NDCG", "MRR"], {"MRR": 100.0}))


def a47(spark, d):
    run, rel = run_of(spark, d)
    s = R.trec_metrics(run, rel, [10]).select(F.col("metric").alias("task"), "value")
    return _rounded(R.suite_average(s, ["NDCG", "MAP", "Recall", "absent"]))


def a36(spark, d):
    """Batch diagnostics over pairs (vec_id, vec_id + 1): in-batch accuracy, norms, positive and negative scores."""
    e = emb(spark, d).withColumn("batch", F.floor(F.col("vec_id") / 20).cast("bigint")).withColumn("e", V.doubles("embedding"))
    a = e.where("vec_id % 2 = 0").select("batch", F.col("vec_id").alias("i"), F.col("e").alias("a"))
    b = e.where("vec_id % 2 = 1").select("batch", (F.col("vec_id") - 1).alias("j"), F.col("e").alias("b"))
    s = a.join(b, "batch").withColumn("s", F.round(V.dot(F.col("a"), F.col("b")), 9)).withColumn("na", V.norm(F.col("a")))
    best = s.groupBy("batch", "i").agg(F.min_by("j", F.struct((-F.col("s")).alias("m"), "j")).alias("best"), F.avg(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("pos"), F.avg(F.when(F.col("i") != F.col("j"), F.col("s"))).alias("neg"), F.max("na").alias("norm"))
    return best.groupBy("batch").agg(F.round(F.avg((F.col("best") == F.col("i")).cast("double")), 6).alias("accuracy"), F.round(F.avg("norm"), 6).alias("norm"), F.round(F.avg("pos"), 6).alias("pos"), F.round(F.avg("neg"), 6).alias("neg"))


def _own(q):
    return q.select("qid", F.explode(F.array(*(F.col("qid") + i for i in (1, 2, 3)))).alias("doc_id"))


def a34(spark, d):
    q, c = split(spark, d)
    run = S.exact_search(q, c, 100, "cos_sim", exclude_self=True)
    return _rounded(P.caption_ranks(run, _own(q)))


def a34_whole(spark, d):
    """A34 with every query and its true rank; A34_caption_ranks has its SQL twin's cut at 100 hits."""
    q, c = split(spark, d)
    return _rounded(P.rank_summary(S.own_ranks(q, c, _own(q))))


def a35(spark, d):
    q, c = split(spark, d)
    return _rounded(S.alignment_uniformity(q, c))


def f22(spark, d):
    return emb(spark, d).select("vec_id", F.posexplode(V.sparse_top(V.doubles("embedding"), 5)).alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), "x.index", F.round("x.weight", 6).alias("weight"))


def f21(spark, d):
    """Masked mean over groups of five vectors, then unit length; a vector takes part if its first component is positive."""
    e = emb(spark, d).withColumn("g", F.floor(F.col("vec_id") / 5).cast("bigint"))
    m = e.where(F.get("embedding", F.lit(0)) > 0).select("g", F.posexplode(V.doubles("embedding")).alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("m"))
    v = m.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("v")).withColumn("v", V.unit(F.col("v")))
    return v.select("g", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def a32(spark, d):
    e = emb(spark, d)
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    f = V.pair_features(V.doubles("a"), V.doubles("b"))
    return a.join(b, "vec_id").select("vec_id", F.size(f).cast("bigint").alias("n"), F.round(V.total(f), 6).alias("total"))


QUERIES = {
    "V1_dense_top10_metrics": v1,
    "V1_exact_cosine": top("cos_sim"),
    "V5_flat_inner_product": top("dot"),
    "V3_euclidean_search": top("euclidean"),
    "V3_manhattan_search": top("manhattan"),
    **{f"V3_pair_{k}": hybrid_fields(k) for k in SCORE_SQL},
    "V2_self_excluded": v2,
    "P7_threshold": p7,
    "V6_pq_recall": recall_against_exact(INDEXES["V6_pq_recall"]),
    "V7_mips_extension": v7,
    "V8_scalar_quantizer": v8,
    "V9_pca_recall": recall_against_exact(INDEXES["V9_pca_recall"]),
    "V10_binary_search": v10,
    "V11_ivf_recall": recall_against_exact(INDEXES["V11_ivf_recall"]),
    "J8_rerank_pool": j8,
    "J9_rerank_own": j9,
    "J16_pairwise_negatives": j16,
    "K10_dense_ids": k10,
    "A1_A2_A3_trec_metrics": metrics(R.trec_metrics),
    "A4_mrr": metrics(R.mrr),
    "A5_recall_cap": metrics(R.recall_cap),
    "A6_hole": metrics(R.hole),
    "A7_accuracy": metrics(R.accuracy),
    "A8_alias": metrics(lambda run, rel, ks: R.custom("acc", run, rel, ks).unionByName(R.custom("R_cap", run, rel, ks))),
    "A9_binary_metrics": metrics(R.binary_metrics),
    "A12_macro_average": a12,
    "A32_pair_features": a32,
    "A34_caption_ranks": a34,
    "A34_caption_ranks_whole": a34_whole,
    "A35_alignment_uniformity": a35,
    "A36_batch_diagnostics": a36,
    "A43_score_pivot": a43,
    "A45_presented": lambda spark, d: R.presented(R.trec_metrics(*run_of(spark, d), [10])),
    "A47_suite_average": a47,
    "F21_pooling": f21,
    "F22_sparse_top": f22,
}

_CAP = f"n2 as (select qid, count(*) as n_rel from qr group by qid), cap as (select 'R_cap' as metric, k, sum(coalesce(hit, 0) / least(n_rel, k)) / count(*) as value from (select * from n2, {KV}) left join (select qid, k, sum(case when rank <= k and rel > 0 then 1.0 else 0 end) as hit from j, {KV} group by qid, k) using (qid, k) group by k)"
_ACC = f"acc as (select 'Accuracy' as metric, k, avg(case when first <= k then 1.0 else 0 end) as value from fq, {KV} group by k)"
SQL = {
    "V1_dense_top10_metrics": f"with {sql_run()}, {TREC}, {MRR} select lower(metric) || '_at_' || k as metric, round(value, 6) as value from (select * from trec where metric <> 'P' union all select * from mrr) where k = 10",
    "V1_exact_cosine": f"with {sql_run()} {RUN_OUT}",
    "V5_flat_inner_product": f"with {sql_run('list_inner_product(q.e, c.e)')} {RUN_OUT}",
    "V3_euclidean_search": f"with {sql_run('-sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))))')} {RUN_OUT}",
    "V3_manhattan_search": f"with {sql_run('-list_sum(list_transform(range(1, 65), lambda i: abs(q.e[i] - c.e[i])))')} {RUN_OUT}",
    **{f"V3_pair_{k}": f"with {PAIRS} select vec_id, la, lb, round({s}, 6) as score from p" for k, s in SCORE_SQL.items()},
    "V2_self_excluded": f"with {sql_run(k=5, where='true')} {RUN_OUT}",
    "P7_threshold": f"with {sql_run(k=5, where=f'round({COS}, 9) >= 0.3')} {RUN_OUT}",
    "V7_mips_extension": "with v as (select vec_id, list_transform(embedding::double[], lambda x: x * (vec_id % 7 + 1)) as e from embeddings), n as (select vec_id, list_inner_product(e, e) as n2 from v) select vec_id, round(sqrt(greatest((select max(n2) from n) - n2, 0)), 6) as extra from n",
    "V8_scalar_quantizer": f"with {sql_run('list_inner_product(q.e, list_transform(c.e, lambda x: round(x, 3)))')} {RUN_OUT}",
    "V10_binary_search": f"""with {Q},
s1 as (select qid, doc_id, q.e as qe, c.e as ce, list_sum(list_transform(range(1, 65), lambda i: ((q.e[i] > 0) <> (c.e[i] > 0))::int)) as ham from q, c where qid <> doc_id),
n as (select * from (select *, row_number() over (partition by qid order by ham, doc_id) as r from s1) where r <= 50),
s as (select qid, doc_id, round(list_sum(list_transform(range(1, 65), lambda i: case when ce[i] > 0 then qe[i] else -qe[i] end)), 9) as score from n),
run as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from s) where rank <= 10) {RUN_OUT}""",
    "J8_rerank_pool": f"""with {sql_run()}, pool as (select distinct doc_id from run where rank <= 3), r2 as (select *, row_number() over (partition by qid order by score desc, doc_id) as rk from s where doc_id in (select doc_id from pool))
select qid, doc_id, round(score, 6) as score, cast(rk as bigint) as rank from r2 where rk <= 5""",
    "J9_rerank_own": f"""with {sql_run()}, s2 as (select qid, doc_id, round(-list_sum(list_transform(range(1, 65), lambda i: abs(q.e[i] - c.e[i]))), 9) as score from run join q using (qid) join c using (doc_id) where rank <= 5)
select qid, doc_id, round(score, 6) as score, cast(row_number() over (partition by qid order by score desc, doc_id) as bigint) as rank from s2""",
    "J16_pairwise_negatives": "with e as (select vec_id, label, embedding::double[] as e from embeddings) select a.label, round(avg(list_inner_product(a.e, b.e)), 6) as mean_negative, count(*) as n from e a join e b on a.label = b.label and a.vec_id <> b.vec_id group by a.label",
    "K10_dense_ids": "select vec_id, row_number() over (order by vec_id) - 1 as index from (select distinct vec_id from embeddings)",
    "A1_A2_A3_trec_metrics": f"with {sql_run()}, {TREC} {OUT} trec",
    "A4_mrr": f"with {sql_run()}, {MRR} {OUT} mrr",
    "A5_recall_cap": f"with {sql_run()}, {_CAP} {OUT} cap",
    "A6_hole": f"with {sql_run()}, x as (select qid, k, count(*) as n from run, {KV} where rank <= k and doc_id not in (select doc_id from qr) group by qid, k), a as (select distinct qid, k from qr, {KV}) {OUT} (select 'Hole' as metric, k, avg(coalesce(n, 0) / k) as value from a left join x using (qid, k) group by k)",
    "A7_accuracy": f"with {sql_run()}, {FIRST}, {_ACC} {OUT} acc",
    "A8_alias": f"with {sql_run()}, {FIRST}, {_ACC}, {_CAP} {OUT} (select * from acc union all select * from cap)",
    "A9_binary_metrics": f"""with {sql_run()}, {FIRST},
n as (select qid, count(*) as n_rel from qr group by qid),
h as (select *, sum((rel > 0)::int) over (partition by qid order by rank) as hits from j),
g as (select qid, k, sum(case when rank <= k and rel > 0 then 1 / log2(rank + 1) else 0 end) as dcg, sum(case when rank <= k and rel > 0 then hits / rank else 0 end) as ap, sum(case when rank <= k and rel > 0 then 1.0 else 0 end) as hit from h, {KV} group by qid, k),
t as (select *, list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda i: 1 / log2(i + 1))) as ideal from (select * from n, {KV}) left join g using (qid, k) left join f using (qid))
{OUT} (select 'accuracy' as metric, k, avg(case when first <= k then 1.0 else 0 end) as value from t group by k union all select 'precision', k, avg(coalesce(hit, 0) / k) from t group by k
union all select 'recall', k, avg(coalesce(hit, 0) / n_rel) from t group by k union all select 'mrr', k, avg(case when first <= k then 1.0 / first else 0 end) from t group by k
union all select 'ndcg', k, avg(coalesce(dcg, 0) / ideal) from t group by k union all select 'map', k, avg(coalesce(ap, 0) / least(n_rel, k)) from t group by k)""",
    "A12_macro_average": f"""with {sql_run()}, {TREC}, {_CAP}, o as (select * from trec union all select * from cap),
a as (select 'one' as dataset, metric, k, value from o where metric <> 'R_cap' union all select 'trec-covid', case when metric = 'R_cap' then 'Recall' else metric end, k, value / 2 from o where metric <> 'Recall'
union all select 'sub', metric, k, (value + value / 4) / 2 from o where metric <> 'R_cap') select metric, cast(k as bigint) as k, round(avg(value), 6) as value, count(*) as n_datasets from a group by metric, k""",
    "A32_pair_features": f"with {PAIRS} select vec_id, cast(2 * len(a) as bigint) as n, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) + list_inner_product(a, b), 6) as total from p",
    "A34_caption_ranks": f"with {sql_run(k=100)}, b as (select qid, min(rank) as r from run where doc_id - qid in (1, 2, 3) group by qid) select round(avg(case when r <= 1 then 100.0 else 0 end), 6) as r1, round(avg(case when r <= 5 then 100.0 else 0 end), 6) as r5, round(avg(case when r <= 10 then 100.0 else 0 end), 6) as r10, cast(floor(quantile_cont(r - 1, 0.5)) + 1 as bigint) as median_rank from b",
    "A35_alignment_uniformity": f"with {Q}, p as (select sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) as d, q.label = c.label as pos from q, c where qid <> doc_id) select round(avg(d * d) filter (where pos), 6) as alignment, round(ln(avg(exp(-2 * d * d))), 6) as uniformity from p",
    "A36_batch_diagnostics": """with e as (select vec_id, vec_id // 20 as batch, embedding::double[] as e from embeddings), s as (select a.batch, a.vec_id as i, b.vec_id - 1 as j, round(list_inner_product(a.e, b.e), 9) as s, sqrt(list_inner_product(a.e, a.e)) as na from e a join e b using (batch) where a.vec_id % 2 = 0 and b.vec_id % 2 = 1),
b as (select batch, i, first(j order by s desc, j) as best, avg(s) filter (where i = j) as pos, avg(s) filter (where i <> j) as neg, max(na) as norm from s group by batch, i) select batch, round(avg((best = i)::int), 6) as accuracy, round(avg(norm), 6) as norm, round(avg(pos), 6) as pos, round(avg(neg), 6) as neg from b group by batch""",
    "A43_score_pivot": f"with {sql_run()}, {TREC}, {MRR} select 'x' as dataset, (select round(value, 6) from trec where k = 10 and metric = 'NDCG') as \"NDCG\", 0.0::double as \"MRR\" union all select 'y', 0.0, (select round(value * 100, 6) from mrr where k = 10)",
    "A45_presented": f"with {sql_run()}, {TREC} select lower(metric) || '_at_' || k as metric, round(value, 5) as value from trec where k = 10",
    "A47_suite_average": f"with {sql_run()}, {TREC} select round(sum(value) / 4, 6) as value, count(*) as n_found from trec where k = 10 and metric <> 'P'",
    "F21_pooling": "with x as (select vec_id // 5 as g, i, avg((embedding::double[])[i]) as m from embeddings, range(1, 65) r(i) where embedding[1] > 0 group by 1, 2), n as (select g, sqrt(sum(m * m)) as n, sum(m) filter (where i = 1) as f from x group by g) select g, round(f / n, 6) as first, 1.0::double as norm from n",
    "F22_sparse_top": "with x as (select vec_id, i - 1 as index, (embedding::double[])[i] as w from embeddings, range(1, 65) r(i)), r as (select *, row_number() over (partition by vec_id order by w desc, index) - 1 as pos from x where w > 0) select vec_id, pos, index, round(w, 6) as weight from r where pos < 5",
}
