"""Lexical search, question answering, text functions and corpus preparation over ``documents``, ``benchmark``,
``conversations`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.rand import sql_uniform, uniform
from corpusloom.lineage import materialize
from corpusloom.operators import lexical as L
from corpusloom.operators import pairs as P
from corpusloom.operators import prep as D
from corpusloom.operators import qa as Q
from corpusloom.operators import ranking as R


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d):
    return t(spark, d, "documents")


def bench(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _num(df, digits=6):
    kinds = {"int": "bigint", "float": "double"}
    return df.select(*(F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c).cast(kinds[k]).alias(c) if k in kinds else F.col(c) for c, k in df.dtypes))


# --- SQL fragments -----------------------------------------------------------------------------
# The classes of white space and punctuation, as RE2 spells them.
WS = r"[\s\x0b\pZ\x1c-\x1f\x{85}]+"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[]^_`{|}~"


def words_sql(x):
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda w: w <> '')"


def bm25_sql(x):
    return words_sql(f"lower(translate({x}, '{PUNCT}', '{' ' * (len(PUNCT) - 1)}'))")


def tokens_sql(x):
    return f"regexp_extract_all({x}, '[\\pL\\pN\\pM]+|[^\\pZ\\pC]')"


POST = f"""tk as (select doc_id, {bm25_sql('text')} as tk from documents),
st as (select count(*) as n, avg(len(tk)) as avgdl from tk),
po as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(tk) as dl, unnest(tk) as term from tk) group by 1, 2),
df as (select term, count(*) as df from po group by 1),
qt as (select qid, term, count(*) as qtf from (select item_id as qid, unnest({bm25_sql('text')}) as term from benchmark) group by 1, 2)"""
RAW = "raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from df, st), idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw)"
TF = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
OKAPI = f"{POST}, {RAW}, sc as (select qid, doc_id, round(sum(qtf * idf * {TF}), 9) as score from qt join idf using (term) join po using (term), st group by 1, 2)"
TOP = "select qid, doc_id, round(score, 6) as score, cast(rank as bigint) as rank from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from sc) where rank <= 10"


def okapi_top(spark, d):
    return _num(R.ranked(L.okapi(L.index(docs(spark, d)), bench(spark, d), k=10), 10).select("qid", "doc_id", "score", "rank"))


def a13(spark, d):
    return _num(L.index(docs(spark, d)).stats)


def a13_df(spark, d):
    return L.index(docs(spark, d)).terms


def a14(spark, d):
    return _num(L.okapi_idf(L.index(docs(spark, d))))


def a16(fn):
    def q(spark, d):
        return _num(R.ranked(fn(L.index(docs(spark, d)), bench(spark, d), k=10), 10).select("qid", "doc_id", "score", "rank"))

    return q


def a17(spark, d):
    even = docs(spark, d).where("doc_id % 2 = 0")
    return _num(R.ranked(L.okapi(L.index(docs(spark, d)), bench(spark, d), docs=even, k=5), 5).select("qid", "doc_id", "score", "rank"))


def lines(spark, d):
    rows = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text")).where("text <> ''")
    return rows.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "text")


def a17_chunks(spark, d):
    return _num(L.best_chunk(lines(spark, d), bench(spark, d)))


def v13(spark, d):
    first = docs(spark, d).select("doc_id", F.substring_index("text", "\n", 1).alias("text"))
    indexes = [L.index(x) for x in (first, docs(spark, d))]
    return _num(L.page(L.best_fields(indexes, bench(spark, d), k=7), 2, 5).select("qid", "doc_id", "score", "rank"))


def a18(spark, d):
    ix = L.index(docs(spark, d))
    weights = ix.postings.select("term", "doc_id", (F.ln(F.col("tf") + 1.0)).alias("weight"))
    q = bench(spark, d).select("qid", F.explode(T.bm25_tokens("text")).alias("term"))
    return _num(R.ranked(L.sparse_scores(q, weights), 10).select("qid", "doc_id", "score", "rank"))


def f24(spark, d):
    """Terms of the next document as a document's scored terms."""
    ix = L.index(docs(spark, d))
    scores = ix.postings.where("doc_id > 0").select((F.col("doc_id") - 1).alias("doc_id"), "term").join(ix.terms.where("df > 20"), "term")
    scores = scores.select("doc_id", "term", (F.col("df") + F.col("doc_id") % 3).cast("double").alias("score"))
    return _num(L.expansion_terms(scores, ix.postings.select("doc_id", "term"), ix.terms.where("df > 500").select("term"), 5).select("doc_id", "term", "score", "rank"))


# --- question answering ------------------------------------------------------------------------
def questions(spark, d):
    """Items with answers: two words of the item, and its 5th to 7th words."""
    w = T.words("text")
    return bench(spark, d).select("qid", "text", F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 5, 3), " ")).alias("answers"))


def okapi_run(spark, d):
    """Each item's first ten documents, written: their size is known, so texts that they are joined with stay where they are."""
    return materialize(R.ranked(L.okapi(L.index(docs(spark, d)), bench(spark, d), k=10), 10), "run")


def qa_hits(spark, d):
    run = okapi_run(spark, d)
    return Q.matched(run, docs(spark, d), questions(spark, d))


def answers_sql(w):
    return f"[array_to_string({w}[1:2], ' '), array_to_string({w}[5:7], ' ')]"


def has_sql(text, a):
    j = lambda x: f"chr(1) || array_to_string({tokens_sql(f'lower({x})')}, chr(1)) || chr(1)"
    return f"(len({tokens_sql(a)}) = 0 or contains({j(text)}, {j(a)}))"


HITS = f"""{OKAPI}, rk as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from sc) where rank <= 10),
an as (select item_id as qid, {answers_sql(words_sql('text'))} as answers from benchmark),
ht as (select rk.qid, rk.doc_id, rk.rank, rk.score, {has_sql('d.text', 'answers[1]')} or {has_sql('d.text', 'answers[2]')} as hit from rk join documents d using (doc_id) join an using (qid)),
fi as (select qid, (select min(rank) from ht where ht.qid = an.qid and hit) as first from an)"""


def f14(spark, d):
    return qa_hits(spark, d).select("qid", "doc_id", "rank", "has_answer").withColumn("rank", F.col("rank").cast("bigint"))


def f14_regex(spark, d):
    q = questions(spark, d).select("qid", F.transform("answers", lambda a: F.regexp_replace(a, r"[^A-Za-z ]", ".{1,2}")).alias("answers"))
    q = q.withColumn("answers", F.concat("answers", F.array(F.lit("("))))
    run = okapi_run(spark, d)
    rows = run.join(docs(spark, d).select("doc_id", "text"), "doc_id").join(q, "qid")
    return rows.select("qid", "doc_id", Q.regex_matched(F.col("text"), F.col("answers"), decomposed=False).alias("has_answer"))


def a10(spark, d):
    h = qa_hits(spark, d)
    return _num(Q.hit_curve(Q.first_hits(h, questions(spark, d)), 10))


def k1(spark, d):
    n = Q.nested_results(qa_hits(spark, d), questions(spark, d))
    return n.select("qid", F.col("hit_min_rank").cast("bigint").alias("hit_min_rank"), F.size("ctxs").cast("bigint").alias("n_ctxs"), F.array_join(F.transform("all_hits", lambda x: x.cast("string")), ",").alias("hits"), F.get("ctxs", F.lit(0))["id"].alias("top_id"))


def a46(spark, d):
    n = Q.nested_results(qa_hits(spark, d), questions(spark, d))
    return _num(Q.rescored(n, docs(spark, d)))


def a11(spark, d):
    """Per-dataset and macro recall@10, data sets by qid."""
    f = Q.first_hits(qa_hits(spark, d), questions(spark, d)).withColumn("dataset", F.concat(F.lit("P"), (F.col("qid") % 4).cast("string")))
    per = f.groupBy("dataset").agg(F.avg(F.when(F.col("first") <= 10, 1.0).otherwise(0.0)).alias("recall"))
    return _num(per.unionByName(per.agg(F.lit("macro").alias("dataset"), F.avg("recall").alias("recall"))))


def a19(spark, d):
    """A text as the prediction; the text without its first two words, and its words two blanks apart, as answers."""
    w = T.words("text")
    rows = docs(spark, d).select("doc_id", F.col("text").alias("prediction"), F.array(F.array_join(F.slice(w, F.lit(3), F.size(w)), " "), F.array_join(w, "  ")).alias("answers"))
    # each text is normalised once; a later step takes the columns as they are
    rows = rows.select("doc_id", T.normalize_answer("prediction").alias("p"), F.transform("answers", T.normalize_answer).alias("a"))
    return _num(rows.select("doc_id", Q.best_overlap_f1(F.col("p"), F.col("a")).alias("f1"), F.array_max(F.transform("a", lambda a: (a == F.col("p")).cast("double"))).alias("em")))


def norm_sql(x):
    return f"array_to_string({words_sql(f'''regexp_replace(translate(lower({x}), '{PUNCT}' || chr(92), ''), '(?:^|\\b)(a|an|the)\\b', ' ', 'g')''')}, ' ')"


def f3(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.normalize_answer(F.lower(F.regexp_replace("text", "[^ -~\n]", "_")))).alias("normal"))


def a20(spark, d):
    """Gold ranks in the order that another score shows them, groups of ten documents."""
    g = docs(spark, d).withColumn("qid", F.floor(F.col("doc_id") / 10).cast("bigint")).withColumn("gold", (F.col("doc_id") % 10).cast("int"))
    lists = g.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("s"), "gold"))), lambda x: x["gold"]).alias("ranks"))
    return _num(Q.order_agreement(lists, 3))


# --- text functions ----------------------------------------------------------------------------
def per_doc(**cols):
    def q(spark, d):
        return docs(spark, d).select("doc_id", *(c().alias(n) for n, c in cols.items()))

    return q


def f8(spark, d):
    x = docs(spark, d).select("doc_id", T.regex_tokens("text", True).alias("t"))
    g = x.select("doc_id", T.ngrams(F.col("t"), 3).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("n"), F.md5(F.array_join("g", "|")).alias("grams"))


def f13(spark, d):
    from corpusloom.functions.markup import parse_markup

    marked = F.concat(F.lit("'''"), F.substring_index("text", " ", 1), F.lit("''' and [[x|y [[z]]]]s "), F.substring_index("text", "\n", 1))
    return docs(spark, d).select("doc_id", parse_markup(marked).alias("m")).select("doc_id", "m.text", F.array_join("m.fonts", "|").alias("fonts"), F.array_join("m.anchors", "|").alias("anchors"))


def p2(spark, d):
    title = F.when(F.col("doc_id") % 2 == 0, F.substring_index("text", "\n", 1)).otherwise("")
    return docs(spark, d).select("doc_id", *(F.md5(T.titled(title, "text", sep, True)).alias(n) for n, sep in (("blank", " "), ("marked", " TEXT: "), ("sep", "[SEP]"))))


def p5(spark, d):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://en.wikipedia.org/"), F.col("url"))).otherwise(F.col("url"))
    pile = F.when(F.col("page_id") % 3 == 0, "Wikipedia (en)").when(F.col("page_id") % 3 == 1, "Pile-CC")
    return t(spark, d, "pages").select("page_id", T.source_of(url, pile).alias("source"))


def a22(spark, d):
    e = t(spark, d, "documents").withColumn("a", F.length("text").cast("double")).withColumn("b", F.col("doc_id") % 17 + F.length("text") / 500)
    per = P.correlations(e.withColumn("b", F.col("b").cast("double")), "a", "b", ["lang"])
    return _num(P.sts_summary(per))


def a44(spark, d):
    e = t(spark, d, "documents").withColumn("a", F.length("text").cast("double")).withColumn("b", (F.col("doc_id") % 17).cast("double"))
    return _num(P.correlations(e, "a", "b", ["lang"]))


QUERIES = {
    "A13_corpus_stats": a13,
    "A13_document_frequency": a13_df,
    "A14_okapi_idf": a14,
    "A15_V12_okapi_top10": okapi_top,
    "A16_bm25_l": a16(L.bm25_l),
    "A16_bm25_plus": a16(L.bm25_plus),
    "A17_subset_scores": a17,
    "A17_G20_best_chunk": a17_chunks,
    "V13_two_fields_page": v13,
    "A18_V15_sparse_dot": a18,
    "A42_vocabulary": lambda s, d: L.vocabulary(docs(s, d)),
    "F24_expansion_terms": f24,
    "F14_has_answer": f14,
    "F14_regex_answer": f14_regex,
    "A10_V21_hit_curve": a10,
    "K1_W6_nested_results": k1,
    "A46_rescored": a46,
    "A11_macro_recall": a11,
    "A19_em_f1": a19,
    "A20_order_agreement": a20,
    "A22_sts_summary": a22,
    "A44_per_language": a44,
    "F1_unicode_normalize": per_doc(clean=lambda: F.md5(T.normalize_unicode(F.concat(F.lit("“a–b” … x″ \x0b"), F.col("text"))))),
    "F2_clean_passage": per_doc(clean=lambda: F.md5(T.clean_passage(F.concat(F.lit('"’'), F.col("text"), F.lit('"'))))),
    "F3_normalize_answer": f3,
    "F4_bm25_tokens": per_doc(n=lambda: F.size(T.bm25_tokens("text")).cast("bigint"), tokens=lambda: F.md5(F.array_join(T.bm25_tokens("text"), " "))),
    "F5_words": per_doc(n=lambda: T.n_words("text"), joined=lambda: F.md5(T.squeeze("text"))),
    "F6_F7_regex_tokens": per_doc(n=lambda: F.size(T.regex_tokens("text")).cast("bigint"), tokens=lambda: F.md5(F.array_join(T.regex_tokens("text"), " "))),
    "F8_ngrams": f8,
    "F10_title": per_doc(title=lambda: T.title_of("text", F.when(F.col("doc_id") % 2 == 0, "Wikipedia").otherwise("x"))),
    "F11_title_v2": per_doc(title=lambda: T.title_v2(F.concat(F.when(F.col("doc_id") % 3 == 0, "Abstract: ").otherwise(""), F.col("text")))),
    "F12_sections": per_doc(n=lambda: F.size(T.wiki_sections(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("bigint"), first=lambda: F.get(T.wiki_sections(F.concat(F.lit("Head\n"), F.replace("text", F.lit("\n"), F.lit("\n\nReferences\n")))), F.lit(0))["header"]),
    "F13_markup": f13,
    "F15_clean_phrase": per_doc(phrase=lambda: F.md5(T.clean_phrase(F.concat(F.lit("[["), F.col("text"), F.lit("|x]]"))))),
    "F16_id_suffix": per_doc(suffix=lambda: T.id_suffix(F.concat_ws("-", F.lit("c4"), F.col("source"), F.col("doc_id").cast("string")))),
    "P2_titled": p2,
    "P3_prefixed": per_doc(text=lambda: F.md5(T.prefixed("query: ", "text"))),
    "P5_source": p5,
}


def doc_sql(**cols):
    return "select doc_id, " + ", ".join(f"{x} as {n}" for n, x in cols.items()) + " from documents"


def corr_sql(by):
    """Pearson and Spearman with averaged ranks."""
    g = f"partition by {by}"
    return f"""rr as (select *, rank() over ({g} order by a) + (count(*) over ({g}, a) - 1) / 2.0 as ra, rank() over ({g} order by b) + (count(*) over ({g}, b) - 1) / 2.0 as rb from x),
co as (select {by}, corr(a, b) as pearson, corr(ra, rb) as spearman, count(*) as n from rr group by {by})"""


SQL = {
    "A13_corpus_stats": f"with {POST} select n as n_docs, round(avgdl, 6) as avgdl from st",
    "A13_document_frequency": f"with {POST} select term, df from df",
    "A14_okapi_idf": f"""with df as materialized (select term, count(*) as df from (select unnest(list_distinct({bm25_sql('text')})) as term from documents) group by 1), st as (select count(*) as n from documents),
raw as materialized (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from df, st), mean as (select avg(r) as m from raw) select term, df, round(case when r < 0 then 0.25 * m else r end, 6) as idf from raw, mean""",
    "A15_V12_okapi_top10": f"with {OKAPI} {TOP}",
    "A16_bm25_l": f"""with {POST}, idf as (select term, ln(n + 1.0) - ln(df + 0.5) as idf from df, st), ba as (select qid, sum(qtf * idf * 2.2 * 0.5 / 1.7) as b from qt join idf using (term) group by 1),
m as (select qid, doc_id, qtf, idf, tf / (0.25 + 0.75 * dl / avgdl) as c from qt join idf using (term) join po using (term), st),
sc as (select qid, doc_id, round(sum(qtf * idf * (2.2 * (c + 0.5) / (1.7 + c) - 2.2 * 0.5 / 1.7)) + any_value(b), 9) as score from m join ba using (qid) group by 1, 2) {TOP}""",
    "A16_bm25_plus": f"""with {POST}, idf as (select term, ln((n + 1.0) / df) as idf from df, st), ba as (select qid, sum(qtf * idf) as b from qt join idf using (term) group by 1),
sc as (select qid, doc_id, round(sum(qtf * idf * {TF}) + any_value(b), 9) as score from qt join idf using (term) join po using (term) join ba using (qid), st group by 1, 2) {TOP}""",
    "A17_subset_scores": f"with {OKAPI.replace('sc as (', 'sc0 as (')}, sc as (select * from sc0 where doc_id % 2 = 0) {TOP.replace('<= 10', '<= 5')}",
    "A17_G20_best_chunk": f"""with ch as (select doc_id, i - 1 as chunk_id, l[i] as text from (select doc_id, string_split(text, chr(10)) as l from documents), range(1, 100000) r(i) where i <= len(l) and l[i] <> ''),
{POST.replace('from documents', "from (select doc_id || '/' || chunk_id as doc_id, text from ch)")}, {RAW},
sc as (select qid, doc_id, round(sum(qtf * idf * {TF}), 9) as score from qt join idf using (term) join po using (term), st group by 1, 2),
x as (select qid, cast(split_part(doc_id, '/', 1) as bigint) as doc_id, cast(split_part(doc_id, '/', 2) as bigint) as chunk_id, score from sc)
select qid, doc_id, chunk_id, round(score, 6) as score from (select *, row_number() over (partition by qid, doc_id order by score desc, chunk_id) as r from x) where r = 1""",
    "V13_two_fields_page": f"""with {OKAPI.replace('sc as (', 'sc2 as (')},
tk1 as (select doc_id, {bm25_sql("split_part(text, chr(10), 1)")} as tk from documents), st1 as (select count(*) as n, avg(len(tk)) as avgdl from tk1),
po1 as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(tk) as dl, unnest(tk) as term from tk1) group by 1, 2), df1 as (select term, count(*) as df from po1 group by 1),
raw1 as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from df1, st1), idf1 as (select term, case when r < 0 then 0.25 * (select avg(r) from raw1) else r end as idf from raw1),
sc1 as (select qid, doc_id, round(sum(qtf * idf * {TF}), 9) as score from qt join idf1 using (term) join po1 using (term), st1 group by 1, 2),
sc as (select qid, doc_id, round(max(score) + 0.5 * (sum(score) - max(score)), 9) as score from (select * from sc1 union all select * from sc2) group by 1, 2)
{TOP.replace('rank <= 10', 'rank between 3 and 7')}""",
    "A18_V15_sparse_dot": f"with {POST}, sc as (select qid, doc_id, round(sum(qtf * ln(tf + 1.0)), 9) as score from qt join po using (term) group by 1, 2) {TOP}",
    "A42_vocabulary": f"with {POST} select term, cast(sum(tf) as bigint) as n from po group by term",
    "F24_expansion_terms": f"""with {POST}, s as (select doc_id - 1 as doc_id, term, df + (doc_id - 1) % 3 as score from po join df using (term) where doc_id > 0 and df > 20 and df <= 500 and regexp_matches(term, '^[A-Za-z0-9_-]*$')),
l as (select * from s anti join po using (doc_id, term)) select doc_id, term, cast(score as double) as score, r as rank from (select *, row_number() over (partition by doc_id order by score desc, term) as r from l) where r <= 5""",
    "F14_has_answer": f"with {HITS} select qid, doc_id, rank, hit as has_answer from ht",
    "F14_regex_answer": f"""with {OKAPI}, rk as (select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from sc) where rank <= 10),
a as (select item_id as qid, list_transform({answers_sql(words_sql('text'))}, lambda a: regexp_replace(a, '[^A-Za-z ]', '.{{1,2}}', 'g')) as an from benchmark)
select qid, doc_id, regexp_matches(text, an[1], 'i') or regexp_matches(text, an[2], 'i') as has_answer from rk join documents using (doc_id) join a using (qid)""",
    "A10_V21_hit_curve": f"with {HITS} select k, round(count(*) filter (where first <= k) / count(*), 6) as recall from fi, range(1, 11) r(k) group by k",
    "K1_W6_nested_results": f"with {HITS} select an.qid, min(rank) filter (where hit) as hit_min_rank, count(rank) as n_ctxs, coalesce(string_agg(rank::varchar, ',' order by rank) filter (where hit), '') as hits, min_by(doc_id, rank) as top_id from an left join ht using (qid) group by an.qid",
    "A46_rescored": f"with {HITS} select qid, first from fi",
    "A11_macro_recall": f"with {HITS}, p as (select 'P' || (qid % 4) as dataset, avg(case when first <= 10 then 1.0 else 0 end) as recall from fi group by 1) select dataset, round(recall, 6) as recall from p union all select 'macro', round(avg(recall), 6) from p",
    "F5_words": doc_sql(n=f"cast(len({words_sql('text')}) as bigint)", joined=f"md5(array_to_string({words_sql('text')}, ' '))"),
    "F4_bm25_tokens": doc_sql(n=f"cast(len({bm25_sql('text')}) as bigint)", tokens=f"md5(array_to_string({bm25_sql('text')}, ' '))"),
    "F6_F7_regex_tokens": doc_sql(n=f"cast(len({tokens_sql('text')}) as bigint)", tokens=f"md5(array_to_string({tokens_sql('text')}, ' '))"),
    "F8_ngrams": f"with k as (select doc_id, {tokens_sql('text')} as t0 from documents), w as (select doc_id, list_transform(t0, lambda x: lower(x)) as t from k), g as (select doc_id, list_concat(t, list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i+1], ' ')), list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) as g from w) select doc_id, cast(len(g) as bigint) as n, md5(array_to_string(g, '|')) as grams from g",
    "F3_normalize_answer": f"select doc_id, md5({norm_sql('''regexp_replace(text, '[^ -~\n]', '_', 'g')''')}) as normal from documents",
    "A19_em_f1": f"""with w as (select doc_id, text, {words_sql('text')} as w from documents), p as (select doc_id, k, text as p, case k when 1 then array_to_string(w[3:], ' ') else array_to_string(w, '  ') end as g from w, range(1, 3) r(k)),
n as (select doc_id, k, {norm_sql('p')} as p, {norm_sql('g')} as g from p), m as (select doc_id, k, p, g, {words_sql('p')} as a, {words_sql('g')} as b from n),
pa as (select doc_id, k, x, count(*) as n from (select doc_id, k, unnest(a) as x from m) group by all), pb as (select doc_id, k, x, count(*) as n from (select doc_id, k, unnest(b) as x from m) group by all),
o as (select doc_id, k, sum(least(pa.n, pb.n)) as same from pa join pb using (doc_id, k, x) group by all)
select doc_id, round(max(case when coalesce(same, 0) = 0 then 0 else 2.0 * same / (len(a) + len(b)) end), 6) as f1, max((p = g)::int::double) as em from m left join o using (doc_id, k) group by doc_id""",
    "A20_order_agreement": """with g as (select doc_id // 10 as qid, doc_id % 10 as gold, row_number() over (partition by doc_id // 10 order by length(text) desc, doc_id % 10) as i from documents)
select qid, (select count(*) from g a join g b on a.qid = b.qid and a.i < b.i and a.gold > b.gold where a.qid = g.qid) as inversions, round(count(*) filter (where i <= 3 and gold < 3) / 3.0, 6) as overlap, max(i) filter (where gold < 3) as cover from g group by qid""",
    "A22_sts_summary": f"with x as (select lang, length(text)::double as a, doc_id % 17 + length(text) / 500 as b from documents), {corr_sql('lang')} select round(avg(pearson), 6) as pearson_mean, round(sum(pearson * n) / sum(n), 6) as pearson_wmean, round(avg(spearman), 6) as spearman_mean, round(sum(spearman * n) / sum(n), 6) as spearman_wmean from co",
    "A44_per_language": f"with x as (select lang, length(text)::double as a, (doc_id % 17)::double as b from documents), {corr_sql('lang')} select lang, round(pearson, 6) as pearson, round(spearman, 6) as spearman, n from co",
    "F2_clean_passage": doc_sql(clean="""md5('''' || translate(text, chr(10) || '’', ' '''))"""),
    "F10_title": f"with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: array_to_string({words_sql('x')}, ' ')) as l from documents), p as (select doc_id, case when doc_id % 2 = 0 then list_filter(l, lambda x: x <> '')[1] else list_filter(l, lambda x: len(string_split(x, ' ')) > 3)[1] end as p from l) select doc_id, array_to_string(string_split(p, ' ')[1:64], ' ') as title from p",
    "F15_clean_phrase": doc_sql(phrase="md5(regexp_replace(split_part('[[' || text || '|x]]', '|', 1), '^[\\[\\]]+|[\\[\\]]+$', '', 'g'))"),
    "F16_id_suffix": doc_sql(suffix="doc_id::varchar"),
    "P2_titled": "with x as (select doc_id, text, case when doc_id % 2 = 0 then split_part(text, chr(10), 1) else '' end as ti from documents) select doc_id, " + ", ".join(f"md5(trim(case when length(ti) > 0 then ti || '{s}' || text else text end, ' ')) as {n}" for n, s in (("blank", " "), ("marked", " TEXT: "), ("sep", "[SEP]"))) + " from x",
    "P3_prefixed": doc_sql(text="md5('query: ' || text)"),
    "P5_source": "select page_id, case when page_id % 5 = 0 or contains(url, 'wikipedia') then 'Wikipedia' when page_id % 3 = 0 then 'Wikipedia' when page_id % 3 = 1 then 'Pile-CC' end as source from pages",
    "F1_unicode_normalize": doc_sql(clean="""md5('"a-b" ... x''''  ' || text)"""),
    "F11_title_v2": f"with x as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string({words_sql('x')}, ' ')), lambda x: x <> '')[1] as p, {words_sql('text')} as w from documents), t as (select doc_id, w, coalesce(array_to_string(string_split(p, ' ')[1:64], ' '), '') as t from x) select doc_id, case when length(t) >= 16 then t else array_to_string(w[1:least(64, greatest(1, len(w) // 2))], ' ') end as title from t",
    "F12_sections": doc_sql(n="cast(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as bigint)", first="'Head'"),
    "F13_markup": "select doc_id, split_part(text, ' ', 1) || ' and y zs ' || split_part(text, chr(10), 1) as text, split_part(text, ' ', 1) as fonts, 'y z' as anchors from documents",
}
