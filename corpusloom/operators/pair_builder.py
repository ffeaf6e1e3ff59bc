"""Training pairs (context, query, document) from records, one chain of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.rand import below, uniform
from corpusloom.functions.text import clean_passage, clean_phrase, title_of, wiki_sections, words

from .sampling import crop, weighted_choice, word_replace


def _text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def pretraining_pairs(
    docs: DataFrame,
    seed: int = 1,
    weights: dict[str, float] | None = None,
    max_context: int = 256,
    doc_deletion: float = 0.1,
    query_crop: bool = False,
    title_source: str | None = "source",
) -> DataFrame:
    """(id, context, query_type, query, doc) of docs(doc_id, text, and optionally title, phrases array, outputs map).
    The context is a crop of the text; candidates for the query are the title, a phrase, a random crop
    and generated outputs, one of which is drawn by weight; the document is another crop with
    words deleted. The outputs of a row are its own."""
    weights = weights or {"title": 1.0, "phrase": 1.0, "crop": 1.0, "output": 1.0}
    key = F.col("doc_id")
    rows = docs.where("text is not null").withColumn("_w", words("text")).where(F.size("_w") > 0)
    rows = rows.withColumn("_ctx", crop(F.col("_w"), seed, key, max_context, max_context, 1, max_context, crop_to_maxlen=True))
    title = F.col("title") if "title" in docs.columns else title_of("text", F.col(title_source) if title_source and title_source in docs.columns else None)
    phrases = F.transform("phrases", clean_phrase) if "phrases" in docs.columns else F.array().cast("array<string>")
    outputs = F.map_values("outputs") if "outputs" in docs.columns else F.array().cast("array<string>")
    pick = lambda a, s: F.when(F.size(a) > 0, F.get(a, below(s, F.size(a), key).cast("int")))
    rows = rows.withColumn("_title", title)
    # the kind is drawn by what a row has; only the drawn one's text is built
    candidates = [
        ("title", F.length("_title") > 0, F.col("_title")),
        ("phrase", F.size(phrases) > 0, pick(phrases, seed + 3)),
        ("crop", F.size("_ctx") > 0, _text(crop(F.col("_ctx"), seed + 4, key))),
        ("output", F.size(outputs) > 0, pick(outputs, seed + 5)),
    ]
    kind = weighted_choice(uniform(seed + 6, key), [(F.when(has, F.lit(n)), weights.get(n, 0.0)) for n, has, _ in candidates])
    rows = rows.withColumn("_kind", kind)
    drawn = F.lit(None).cast("string")
    for n, _, text in candidates:
        drawn = F.when(F.col("_kind") == n, text).otherwise(drawn)
    rows = rows.withColumn("_q", F.struct(F.col("_kind").alias("type"), drawn.alias("text")))
    doc = word_replace(crop(F.col("_ctx"), seed + 7, key, 0.05, 0.5, 4, 64), seed + 8, key, doc_deletion)
    query = F.col("_q.text")
    if query_crop:
        query = _text(crop(words(query), seed + 9, key, 0.5, 1.0, 1, 64))
    return rows.select(F.col("doc_id").alias("id"), _text(F.col("_ctx")).alias("context"), F.col("_q.type").alias("query_type"), query.alias("query"), _text(doc).alias("doc"))


def simple_documents(docs: DataFrame) -> DataFrame:
    """(id, title, doc): the first section of each text, its header as the title where it has one (G12). Texts without a
    section are left out."""
    first = F.get(wiki_sections("text"), F.lit(0))
    return docs.withColumn("_s", first).where("_s is not null").select(F.col("doc_id").alias("id"), F.coalesce("_s.header", F.lit("")).alias("title"), F.col("_s.body").alias("doc"))


def dpr_pairs(records: DataFrame, seed: int = 1, pseudo_query_ratio: float = 0.5) -> DataFrame:
    """First positive as the document; the query is the question, or with the given probability's complement a crop of it."""
    key = F.col("question_id")
    doc = clean_passage(F.get("positive_ctxs", F.lit(0))["text"])
    question = F.replace("question", F.lit("’"), F.lit("'"))
    pseudo = _text(crop(words(doc), seed + 1, key))
    return records.where(F.size("positive_ctxs") > 0).select("question_id", F.when(uniform(seed, key) <= pseudo_query_ratio, question).otherwise(pseudo).alias("query"), doc.alias("doc"))


def without_gold(ctxs: Column) -> Column:
    """Positives that carry a score, if any do."""
    scored = F.filter(ctxs, lambda c: c["score"].isNotNull())
    return F.when(F.size(scored) > 0, scored).otherwise(ctxs)


def finetune_rows(records: DataFrame, seed: int = 1, negative: str = "first", hard_ratio: float = 0.5, sep: str = "[SEP]") -> DataFrame:
    """(question_id, query, positive, negative): a hard negative with the given probability where there is one."""
    key = F.col("question_id")
    full = lambda c: F.when(F.length(c["title"]) > 0, F.concat(c["title"], F.lit(sep), c["text"])).otherwise(c["text"])
    pick = lambda a, s: F.get(a, (F.lit(0) if negative == "first" else below(s, F.greatest(F.size(a), F.lit(1)), key)).cast("int"))
    hard = (F.size("hard_negative_ctxs") > 0) & (uniform(seed, key) < hard_ratio)
    chosen = F.when(hard | (F.size("negative_ctxs") == 0), full(pick("hard_negative_ctxs", seed + 1))).otherwise(full(pick("negative_ctxs", seed + 2)))
    return records.where(F.size("positive_ctxs") > 0).select("question_id", F.col("question").alias("query"), full(F.get("positive_ctxs", F.lit(0))).alias("positive"), chosen.alias("negative"))


def medi_rows(records: DataFrame, with_negative: bool = True) -> DataFrame:
    """Texts without their prompts."""
    cols = [F.col("query.text").alias("query"), F.col("pos.text").alias("positive")]
    return records.select(*cols, *([F.col("neg.text").alias("negative")] if with_negative else []))


def dev_pairs(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Two independent crops of 8 to 128 words."""
    rows = docs.where("text is not null").withColumn("_w", words("text")).where(F.size("_w") > 0)
    at = lambda s: _text(crop(F.col("_w"), s, F.col("doc_id"), 8, 128, 8, 128))
    return rows.select("doc_id", at(seed).alias("query"), at(seed + 1).alias("doc"))


def materialised_pairs(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, query, doc_id, doc) of relevant judgements; judgements of missing documents are skipped."""
    rel = qrels.where("rel >= 1").select("qid", "doc_id")
    return rel.join(queries.select("qid", F.col("text").alias("query")), "qid").join(corpus.select("doc_id", F.col("text").alias("doc")), "doc_id")
