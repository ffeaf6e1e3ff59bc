"""Round trips through readers and writers, and the streaming export, over files made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.lineage import shared_path
from corpusloom.operators import lexical as L
from corpusloom.operators import qa as QA
from corpusloom.operators import ranking as R
from corpusloom.sources import readers as I
from corpusloom.sources import writers as O
from corpusloom.streaming import corpus as ST

from .data import JUDGED, judged
from .dense import KS, OUT, TREC, run_of, sql_run
from .texts import HITS, POST, _num, bench, docs, qa_hits, questions, t, words_sql


def here(s, tag):
    return shared_path(s, tag)


def titled(s, d):
    return docs(s, d).select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")


def beir_folder(s, d):
    p = here(s, "beir")
    O.corpus_json(titled(s, d), f"{p}/corpus.jsonl")
    bench(s, d).select(F.col("qid").cast("string").alias("_id"), "text").write.json(f"{p}/queries.jsonl")
    O.qrels_tsv(judged(s, d), f"{p}/qrels/test.tsv")
    return p


def s1(s, d):
    _, q, _ = I.beir(s, beir_folder(s, d), strict=True)
    return q.select("qid", F.md5("text").alias("text"))


def s3(s, d):
    return I.corpus(s, f"{beir_folder(s, d)}/corpus.jsonl").select("doc_id", F.md5("title").alias("title"), F.md5("text").alias("text"))


def s4(s, d):
    return _num(I.qrels(s, f"{beir_folder(s, d)}/qrels/test.tsv"))


def s5(s, d):
    p = here(s, "passages")
    x = titled(s, d).select(F.col("doc_id").cast("string").alias("id"), F.translate("text", "\n", " ").alias("text"), "title")
    x.write.option("header", True).option("escape", '"').csv(f"{p}/a.tsv", sep="\t", compression="gzip")
    return I.passages(s, f"{p}/a.tsv").select("id", F.md5("text").alias("text"), F.md5("title").alias("title"))


def s7(s, d):
    p = here(s, "qa")
    q = questions(s, d).select(F.translate("text", "\n", " ").alias("question"), "answers", "qid")
    literal = F.concat(F.lit("['"), F.array_join(F.transform("answers", lambda a: F.replace(a, F.lit("'"), F.lit("\\'"))), "', '"), F.lit("']"))
    q.where("qid % 2 = 0").select("question", literal.alias("a")).coalesce(1).write.option("escape", '"').csv(f"{p}/nq.v1-test.csv", sep="\t")
    q.where("qid % 2 = 1").select("question", "answers").coalesce(1).write.json(f"{p}/P1.jsonl")
    return I.qa(s, f"{p}/*-test.csv,{p}/P*.jsonl").select(F.md5("question").alias("question"), F.array_join("answers", "|").alias("answers"), "entity")


def s15(s, d):
    p = here(s, "emb")
    e = t(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    O.embedding_shards(e, f"{p}/all", 4)
    return I.embeddings(s, f"{p}/all").select("id", F.size("embedding").cast("bigint").alias("dims"))


def s16(s, d):
    """Five shards, a folder each, of which the second of two ranks gets the last two; and the first alone."""
    p = here(s, "tokens")
    rows = docs(s, d).select(F.col("doc_id").alias("id"), F.transform(F.split("text", " "), lambda x: F.length(x)).alias("tokens"), (F.col("doc_id") % 5).alias("g"))
    rows.write.partitionBy("g").parquet(p)
    parts = {"split": I.token_shards(s, p, "split", 1, 2, folders=True), "single": I.token_shards(s, p, "single", folders=True), "full": I.token_shards(s, p, folders=True)}
    out = None
    for mode, df in parts.items():
        df = df.groupBy().agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens"), F.sum("id").alias("ids")).select(F.lit(mode).alias("mode"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def s17(s, d):
    p = here(s, "shards")
    docs(s, d).select(F.col("doc_id").alias("id"), "lang", F.floor(F.col("doc_id") / 100).alias("g")).write.partitionBy("g").json(p)
    return I.shards(s, p, "id bigint, lang string").select("id", "lang")


def s18(s, d):
    p = here(s, "array")
    whole = docs(s, d).select(F.col("doc_id").alias("id"), "source")
    whole.agg(F.to_json(F.struct(F.collect_list(F.struct("id", "source")).alias("data"))).alias("value")).coalesce(1).write.text(p)
    return I.json_array(s, p, "id bigint, source string")


def s19(s, d):
    p = here(s, "sts")
    x = docs(s, d).select("doc_id", F.concat_ws("\t", F.concat(F.lit("d"), F.col("doc_id")), F.col("lang")).alias("pair"), F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.col("doc_id") % 6).cast("string")).alias("gold"))
    x.orderBy("doc_id").coalesce(1).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "pair"))), lambda v: v["pair"]), "\n").alias("value")).write.text(f"{p}/pairs")
    x.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "gold"))), lambda v: v["gold"]), "\n").alias("value")).write.text(f"{p}/gold")
    return I.sts_pairs(s, f"{p}/pairs", f"{p}/gold")


def s20(s, d):
    p = here(s, "probing")
    code = F.element_at(F.array(F.lit("tr"), F.lit("va"), F.lit("te")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs(s, d).select(F.concat_ws("\t", code, F.col("lang"), F.concat(F.lit("id"), F.col("doc_id"))).alias("value")).write.text(p)
    return I.probing(s, p)


def s23(s, d):
    p = here(s, "langs")
    docs(s, d).select("doc_id", "lang").write.partitionBy("lang").parquet(p)
    return I.per_language(s, p, ["de", "fr"])


def s11(s, d):
    p = here(s, "pile")
    docs(s, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.struct(F.col("source").alias("pile_set_name")).alias("meta")).write.json(p)
    return I.named(s, "pile_src3", p).withColumn("text", F.md5("text"))


def s12(s, d):
    p = here(s, "dev")
    docs(s, d).select("doc_id", "lang", "source").write.option("header", True).csv(f"{p}/x.tsv", sep="\t")
    return I.by_extension(s, f"{p}/x.tsv", "doc_id bigint, lang string, source string")


def s13(s, d):
    from .data import k6
    from corpusloom.operators import negatives as N

    from .data import dense_run

    p = here(s, "dpr")
    q, c, run, rel = dense_run(s, d)
    corpus = c.select("doc_id", F.lit("t").alias("title"), F.col("doc_id").cast("string").alias("text"))
    O.training_records(N.training_records(q.select("qid", F.col("qid").cast("string").alias("text")), rel, corpus, None, N.hard_negatives(run, rel, 5), "emb"), f"{p}/r.jsonl")
    return I.dpr_records(s, f"{p}/r.jsonl").select("question_id", F.get("positive_ctxs", F.lit(0))["passage_id"].alias("positive"), F.size("hard_negative_ctxs").cast("bigint").alias("n_hard"))


def s14(s, d):
    p = here(s, "medi")
    side = lambda x: F.struct(F.lit("p").alias("prompt"), x.alias("text"))
    t(s, d, "conversations").select(side(F.col("role")).alias("query"), side(F.col("turn").cast("string")).alias("pos"), side(F.lit("n")).alias("neg")).write.json(p)
    return I.medi(s, p).groupBy("query.text", F.col("pos.text").alias("pos")).agg(F.count("*").alias("n"))


def s21(s, d):
    p = here(s, "scores")
    run, rel = run_of(s, d)
    O.benchmark_scores(R.trec_metrics(run, rel, KS), p, "emb")
    return _num(I.score_files(s, f"{p}/json").select("dataset", "metric", F.col("k").cast("bigint").alias("k"), "value"))


def k2(s, d):
    p = here(s, "curve")
    O.recall_curve(QA.hit_curve(QA.first_hits(qa_hits(s, d), questions(s, d)), 10), p)
    return _num(s.read.schema("k bigint, recall double").csv(p, header=True))


def k3(s, d):
    run, rel = run_of(s, d)
    return _num(O.wide_scores(R.trec_metrics(run, rel, KS), KS))


def k5(s, d):
    p = here(s, "generated")
    rows = docs(s, d).select(F.concat(F.lit("genQ"), F.col("doc_id")).alias("qid"), "doc_id", F.substring_index("text", " ", 3).alias("query"), F.lit(1).alias("rel"))
    O.generated_queries(rows, p)
    O.corpus_json(titled(s, d), f"{p}/corpus.jsonl")
    _, q, r = I.beir(s, p, "train", prefix="gen")
    return _num(q.join(r, "qid").select("qid", "doc_id", F.md5("text").alias("text"), "rel"))


def k7(s, d):
    p = here(s, "subsets")
    O.by_subset(docs(s, d).withColumn("source", F.concat(F.lit("set "), F.col("source"))).select("doc_id", "source"), p)
    return s.read.schema("doc_id bigint, source string, subset string").json(p)


def k8(s, d):
    p = here(s, "bm25")
    O.bm25_statistics(L.index(docs(s, d)), p)
    return s.read.parquet(f"{p}/terms").join(s.read.parquet(f"{p}/stats")).agg(F.count("*").alias("n_terms"), F.max("n_docs").alias("n_docs"), F.sum("df").alias("total_df"))


def k9(s, d):
    p = here(s, "index")
    O.vector_index(t(s, d, "embeddings").select("vec_id", "label"), p)
    return _num(O.read_vector_index(s, p))


def k11(s, d):
    run, rel = run_of(s, d)
    x = R.trec_metrics(run, rel, [10]).select(F.lit("emb").alias("task"), F.lower("metric").alias("metric"), F.round("value", 4).alias("value"))
    return O.model_card(x.unionByName(x.withColumn("metric", F.concat(F.col("metric"), F.lit("_std")))))


def k13(s, d):
    p = here(s, "task")
    one = t(s, d, "labels").agg(F.count("*").alias("n"))
    O.task_result(one, p)
    O.task_result(one.select((F.col("n") * 0).alias("n")), p)
    return s.read.schema("n bigint").json(p)


def stream_export(s, d):
    p = here(s, "stream")
    docs(s, d).select("doc_id", "source", "lang").repartition(6).write.json(f"{p}/in")
    stream = ST.read(s, f"{p}/in", "doc_id bigint, source string, lang string", files_per_trigger=2)
    ST.export_by_subset(stream, f"{p}/out", f"{p}/state").awaitTermination()
    return s.read.schema("doc_id bigint, source string, lang string, epoch int, subset string").json(f"{p}/out").select("doc_id", "subset", "lang")


def last_keys(s, d):
    return ST.last_keys(t(s, d, "embeddings").select("vec_id", "label"), "vec_id", 96).select("vec_id", F.col("slot").cast("bigint").alias("slot"))


QUERIES = {
    "S1_S2_beir_queries": s1,
    "S3_K4_corpus_json": s3,
    "S4_K4_qrels_tsv": s4,
    "S5_S6_passages": s5,
    "S7_S8_S9_question_sets": s7,
    "S10_S12_by_extension": s12,
    "S11_named_source": s11,
    "S13_K6_dpr_records": s13,
    "S14_medi": s14,
    "S15_S16_K12_embedding_shards": s15,
    "S16_token_shards": s16,
    "S17_shard_walk": s17,
    "S18_json_array": s18,
    "S19_sts_pairs": s19,
    "S20_probing": s20,
    "S21_score_files": s21,
    "S23_per_language": s23,
    "K2_recall_curve": k2,
    "K3_wide_scores": k3,
    "K5_generated_queries": k5,
    "K7_by_subset": k7,
    "K8_bm25_statistics": k8,
    "K9_vector_index": k9,
    "K11_model_card": k11,
    "K13_task_result": k13,
    "ST_streamed_export": stream_export,
    "ST_last_keys": last_keys,
}

SQL = {
    "S16_token_shards": "select mode, count(*) as n, sum(len(string_split(text, ' ')))::bigint as tokens, sum(doc_id)::bigint as ids from documents, (values ('split', 3, 4), ('single', 0, 0), ('full', 0, 4)) m(mode, lo, hi) where doc_id % 5 between lo and hi group by mode",
    "S1_S2_beir_queries": f"with {JUDGED} select item_id::varchar as qid, md5(text) as text from benchmark where item_id in (select qid from qr)",
    "S3_K4_corpus_json": "select doc_id::varchar as doc_id, md5(split_part(text, chr(10), 1)) as title, md5(text) as text from documents",
    "S4_K4_qrels_tsv": f"with {JUDGED} select qid::varchar as qid, doc_id::varchar as doc_id, 1::bigint as rel from qr",
    "S5_S6_passages": "select doc_id::varchar as id, md5(replace(text, chr(10), ' ')) as text, md5(split_part(text, chr(10), 1)) as title from documents",
    "S7_S8_S9_question_sets": f"with w as (select text, {words_sql('text')} as w from benchmark) select md5(replace(text, chr(10), ' ')) as question, array_to_string(w[1:2], ' ') || '|' || array_to_string(w[5:7], ' ') as answers, null::varchar as entity from w",
    "S10_S12_by_extension": "select doc_id, lang, source from documents",
    "S11_named_source": "select doc_id::varchar as id, null::varchar as title, md5(text) as text from documents where source = 'src3'",
    "S13_K6_dpr_records": f"with {sql_run(k=10)}, f as (select qid, min(doc_id) as doc_id from qr group by qid), h as (select qid, count(*) as n from run where rank <= 5 and not exists (select 1 from f where f.qid = run.qid and f.doc_id = run.doc_id) group by qid) select qid::varchar as question_id, doc_id::varchar as positive, coalesce(n, 0) as n_hard from f left join h using (qid)",
    "S14_medi": "select role as text, turn::varchar as pos, count(*) as n from conversations group by 1, 2",
    "S15_S16_K12_embedding_shards": "select vec_id::varchar as id, cast(len(embedding) as bigint) as dims from embeddings",
    "S17_shard_walk": "select doc_id as id, lang from documents",
    "S18_json_array": "select doc_id as id, source from documents",
    "S19_sts_pairs": "select row_number() over (order by doc_id) - 1 as line, 'd' || doc_id as s1, lang as s2, (doc_id % 6)::double as gold from documents qualify doc_id % 3 <> 0",
    "S20_probing": "select ['train', 'dev', 'test'][doc_id % 3 + 1] as split, lang as label, 'id' || doc_id as text from documents",
    "S21_score_files": f"with {sql_run()}, {TREC} select 'emb' as dataset, metric, k, value from ({OUT} trec)",
    "S23_per_language": "select doc_id, lang from documents where lang in ('de', 'fr')",
    "K2_recall_curve": f"with {HITS} select k, round(count(*) filter (where first <= k) / count(*), 6) as recall from fi, range(1, 11) r(k) group by k",
    "K3_wide_scores": f"with {sql_run()}, {TREC}, o as ({OUT} trec) select metric, " + ", ".join(f"max(value) filter (where k = {k}) as \"@{k}\"" for k in KS) + " from o group by metric",
    "K5_generated_queries": "select 'genQ' || doc_id as qid, doc_id::varchar as doc_id, md5(array_to_string(string_split(text, ' ')[1:3], ' ')) as text, 1::bigint as rel from documents",
    "K7_by_subset": "select doc_id, 'set ' || source as source, 'set_' || source as subset from documents",
    "K8_bm25_statistics": f"with {POST} select count(*) as n_terms, any_value(n) as n_docs, cast(sum(df) as bigint) as total_df from df, st",
    "K9_vector_index": "select vec_id, label::bigint as label from embeddings",
    "K11_model_card": f"with {sql_run()}, {TREC} select 'emb' as task, '- type: ' || lower(metric) || chr(10) || '  value: ' || round(round(value, 4) * 100, 4)::varchar as line from trec where k = 10",
    "K13_task_result": "select count(*) as n from labels",
    "ST_streamed_export": "select doc_id, source as subset, lang from documents",
    "ST_last_keys": "with x as (select vec_id, row_number() over (order by vec_id desc) as r, count(*) over () as n from embeddings) select vec_id, (n - r) % 96 as slot from x where r <= 96",
}
