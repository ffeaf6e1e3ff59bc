"""Remaining scalar functions, joins and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import misc as M
from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.lineage import shared_path
from corpusloom.operators import hooks as H
from corpusloom.operators import lexical as L
from corpusloom.operators import pair_builder as B
from corpusloom.operators import ranking as R
from corpusloom.operators import sampling as G
from corpusloom.operators import search as S

from .dense import _rounded, emb, qrels, run_of, split, sql_run
from .texts import OKAPI, bench, docs, t, tokens_sql


def f18(s, d):
    line = F.to_json(F.struct("doc_id", F.struct(F.col("source").alias("pile_set_name")).alias("meta")))
    return docs(s, d).select("doc_id", M.json_field(line, "doc_id bigint, meta struct<pile_set_name:string>", "meta.pile_set_name").alias("subset"))


def f19(s, d):
    m = F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("source"))
    u = M.map_without(M.map_updated(m, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.col("lang"))), "a")
    return docs(s, d).select("doc_id", u["a"].alias("a"), u["b"].alias("b"), u["c"].alias("c"), F.size(u).cast("bigint").alias("n"))


def f20(s, d):
    e = V.doubles("embedding")
    return emb(s, d).select(
        "vec_id",
        F.round(V.total(M.log1p_relu(e)), 6).alias("log1p_relu"),
        F.round(M.log_sum_exp(e), 6).alias("log_sum_exp"),
        F.round(V.total(M.sign(e)), 6).alias("sign"),
        F.round(V.total(M.tanh_scaled(e, 2.0)), 6).alias("tanh"),
        F.round(V.dot(M.unpack_bits(V.bits(e), 64), e), 6).alias("unpacked"),
    )


def f23(s, d):
    x = docs(s, d).select("doc_id")
    return x.select("doc_id", F.round(M.linear_schedule(F.col("doc_id"), 10, 90), 6).alias("linear"), F.round(M.cosine_schedule(F.col("doc_id"), 10, 90, 2, 0.5), 6).alias("cosine"))


def j2(s, d):
    run, rel = run_of(s, d)
    return _rounded(R.judged(run.select("qid", "doc_id", "score"), rel, 10).select("qid", "doc_id", "rank", "rel"))


def j5(s, d):
    q, c = split(s, d)
    return _rounded(R.ranked(R.without_self(S.exact_search(q, c, 6).select("qid", "doc_id", "score")), 5).select("qid", "doc_id", "rank"))


def u2(s, d):
    e = emb(s, d)
    q, c = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid")), e.select(F.col("vec_id").alias("doc_id"))
    table = e.select("vec_id", "embedding")
    r = H.ExactRetriever(H.Precomputed(table.withColumnRenamed("vec_id", "qid"), "qid"), H.Precomputed(table.withColumnRenamed("vec_id", "doc_id"), "doc_id"))
    return _rounded(r.search(q, c, 3).select("qid", "doc_id", "rank"))


def u7(s, d):
    score = H.cross_encoder(lambda a, b: [float(len(set(x.split()) & set(y.split()))) for x, y in zip(a, b, strict=True)])
    x = t(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"))
    y = t(s, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return x.join(y, ["conv_id", "turn"]).select("conv_id", "turn", score("a", "b").alias("score"))


def u10(s, d):
    g = H.generate(docs(s, d), lambda x: F.slice(T.words(x), 1, 3))
    return g.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("query").alias("least"))


def g19(s, d):
    """Longest query and document of each batch of 32 rows in order."""
    x = docs(s, d).select(F.floor(F.col("doc_id") / 32).cast("bigint").alias("batch"), T.n_words("text").alias("n"))
    return x.groupBy("batch").agg(F.max("n").alias("longest"), F.count("*").alias("rows"))


def u1(s, d):
    """Upper-cased languages, batch by batch."""
    return H.map_batches(docs(s, d).select("doc_id", "lang"), lambda x: x.assign(lang=x["lang"].str.upper()), "doc_id bigint, lang string")


def u3(s, d):
    e = emb(s, d)
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    largest = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return _rounded(H.scored(pairs, {"dot": V.SCORES["dot"], "largest": largest}).select("vec_id", "dot", "largest"))


def u4(s, d):
    ix = L.index(docs(s, d), tokenizer=lambda x: T.regex_tokens(x, True))
    return ix.terms


def u5(s, d):
    g = T.ngrams(T.words("text"), 2, keep=lambda x: ~F.contains(x, F.lit("e")))
    return docs(s, d).select("doc_id", F.size(g).cast("bigint").alias("n"), F.md5(F.array_join(g, "|")).alias("grams"))


def u6(s, d):
    encoder = H.BatchEncoder(lambda rows: rows.count(), lambda n, texts: [[float(len(x or "")), float(n)] for x in texts])
    return encoder.encode(docs(s, d).select("doc_id", "text")).select("doc_id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("rows"))


def u9(s, d):
    e = emb(s, d)
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return _rounded(H.REGISTRY["similarity"](pairs, "dot").select("vec_id", "score"))


def g12(s, d):
    x = docs(s, d).withColumn("text", F.concat(F.lit("Head\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return B.simple_documents(x).select("id", "title", F.md5("doc").alias("doc"))


def g15(s, d):
    """Contexts by the named configuration with one value overridden."""
    c = G.config("contriever256", '{"max_context_len": 64}')
    w = T.words("text")
    return docs(s, d).select("doc_id", F.size(G.crop(w, 1, F.col("doc_id"), c["max_context_len"], c["max_context_len"], 1, c["max_context_len"], crop_to_maxlen=True)).cast("bigint").alias("n"))


def v14(s, d):
    path = shared_path(s, "index")
    L.save(L.index(docs(s, d)), path)
    found = L.retrieve(L.load(s, path), bench(s, d), docs(s, d), 5)
    return _rounded(found.select("qid", "doc_id", "score", "rank", F.md5("text").alias("text")))


QUERIES = {
    "U1_map_batches": u1,
    "U3_named_scores": u3,
    "U4_tokenizer": u4,
    "U5_ngram_filter": u5,
    "U6_prepare_batcher": u6,
    "U9_registered_task": u9,
    "F17_utf8": lambda s, d: docs(s, d).select("doc_id", F.md5(T.utf8("text")).alias("text")),
    "G12_simple_documents": g12,
    "G15_named_config": g15,
    "V14_prebuilt_index": v14,
    "F18_json_field": f18,
    "F19_map_update": f19,
    "F20_vector_math": f20,
    "F23_schedules": f23,
    "J2_judged_run": j2,
    "J5_without_self": j5,
    "U2_U8_encoder_retriever": u2,
    "U7_cross_encoder": u7,
    "U10_generator": u10,
    "G19_batch_lengths": g19,
}

W = r"list_filter(regexp_split_to_array(text, '[\s\x0b\pZ\x1c-\x1f\x{85}]+'), lambda w: w <> '')"
PAIRED = "p as (select a.vec_id, a.embedding::double[] as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
SQL = {
    "U1_map_batches": "select doc_id, upper(lang) as lang from documents",
    "U3_named_scores": f"with {PAIRED} select vec_id, round(list_inner_product(a, b), 6) as dot, round(list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 6) as largest from p",
    "U4_tokenizer": f"select term, count(*) as df from (select unnest(list_distinct(list_transform({tokens_sql('text')}, lambda x: lower(x)))) as term from documents) group by 1",
    "U5_ngram_filter": f"with w as (select doc_id, {W} as w from documents), g as (select doc_id, list_filter(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), lambda x: not contains(x, 'e')) as g from w) select doc_id, len(g)::bigint as n, md5(array_to_string(g, '|')) as grams from g",
    "U6_prepare_batcher": "select doc_id, length(text)::double as chars, (select count(*) from documents)::double as rows from documents",
    "U9_registered_task": f"with {PAIRED} select vec_id, round(list_inner_product(a, b), 6) as score from p",
    "F17_utf8": "select doc_id, md5(text) as text from documents",
    "G12_simple_documents": "select doc_id as id, 'Head' as title, md5(split_part(text, chr(10), 1)) as doc from documents",
    "G15_named_config": f"select doc_id, least(len({W}), 64)::bigint as n from documents",
    "V14_prebuilt_index": f"with {OKAPI} select qid, doc_id, round(score, 6) as score, cast(rank as bigint) as rank, md5(text) as text from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from sc) join documents using (doc_id) where rank <= 5",
    "F18_json_field": "select doc_id, source as subset from documents",
    "F19_map_update": "select doc_id, null::varchar as a, 'new' as b, lang as c, 2::bigint as n from documents",
    "F20_vector_math": "with e as (select vec_id, embedding::double[] as e from embeddings) select vec_id, round(list_sum(list_transform(e, lambda x: ln(1 + greatest(x, 0)))), 6) as log1p_relu, round(ln(list_sum(list_transform(e, lambda x: exp(x)))), 6) as log_sum_exp, round(list_sum(list_transform(e, lambda x: sign(x)))::double, 6) as sign, round(list_sum(list_transform(e, lambda x: tanh(2 * x))), 6) as tanh, round(list_sum(list_transform(e, lambda x: abs(x))), 6) as unpacked from e",
    "F23_schedules": "with x as (select doc_id, (doc_id - 10) / 80.0 as p from documents) select doc_id, round(case when doc_id < 10 then doc_id / 10.0 else greatest(0, (90 - doc_id) / 80.0) end, 6) as linear, round(case when doc_id < 10 then doc_id / 10.0 when p >= 1 then 0 else pow(0.5, floor(p * 2)) * 0.5 * (1 + cos(pi() * (p * 2 - floor(p * 2)))) end, 6) as cosine from x",
    "J2_judged_run": f"with {sql_run()} select qid, doc_id, rank, rel::bigint as rel from j",
    "J5_without_self": f"with {sql_run(k=5, where='true')} select qid, doc_id, rank from run",
    "U2_U8_encoder_retriever": f"with {sql_run(k=3)} select qid, doc_id, rank from run",
    "U7_cross_encoder": f"with w as (select conv_id, turn, list_distinct({W}) as w from conversations) select a.conv_id, a.turn, len(list_intersect(a.w, b.w))::double as score from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1",
    "U10_generator": f"with w as (select doc_id, unnest({W}[1:3]) as q from documents) select doc_id, count(*) as n, min(q) as least from w group by 1",
    "G19_batch_lengths": f"select doc_id // 32 as batch, max(len({W}))::bigint as longest, count(*) as rows from documents group by 1",
}
