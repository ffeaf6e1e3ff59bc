"""Question answering: answer match, overlap scores, hit curves."""


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import MARK, bound, contains_tokens, nfd, nfd_each, normalize_answer, words


def matched(run: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """Ranked run with passage text and has_answer (J1, F14). run(qid, doc_id, score, rank),
    passages(doc_id, text), questions(qid, answers)."""
    rows = run.join(passages.select("doc_id", "text"), "doc_id").join(questions.select("qid", "answers"), "qid")
    rows = rows.withColumn("_text", nfd("text")).withColumn("_answers", nfd_each("answers"))
    return rows.withColumn("has_answer", F.exists("_answers", lambda a: contains_tokens(F.col("_text"), a))).drop("answers", "_text", "_answers")


def regex_matched(text: F.Column, answers: F.Column, decomposed: bool = True):
    """Regex mode: any answer is a pattern found in the text, both decomposed; invalid patterns match nothing.
    decomposed=False takes both as they are, so that a pattern's dot is a character of the text."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def found(texts: pd.Series, many: pd.Series) -> pd.Series:
        import unicodedata

        import regex

        nfd = lambda x: unicodedata.normalize("NFD", x) if decomposed else x
        known: dict = {}

        def pattern(p):
            if p not in known:
                try:
                    known[p] = regex.compile(nfd(p), flags=regex.IGNORECASE | regex.UNICODE | regex.MULTILINE)
                except Exception:
                    known[p] = None
            return known[p]

        return pd.Series([t is not None and any((c := pattern(p)) is not None and c.search(nfd(t)) is not None for p in (a if a is not None else ())) for t, a in zip(texts, many, strict=True)])

    return found(text, answers)


def first_hits(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, first): the rank of each question's first hit, null where it has none."""
    first = hits.where("has_answer").groupBy("qid").agg(F.min("rank").alias("first"))
    return questions.select("qid").join(first, "qid", "left")


def hit_curve(first: DataFrame, n_docs: int) -> DataFrame:
    """(k, recall) for k from 1 to n_docs: share of questions with a hit at rank k or better."""
    counts = first.groupBy("first").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ks = first.sparkSession.range(1, n_docs + 1).select(F.col("id").alias("k"))
    rows = ks.join(F.broadcast(counts.where("first is not null")), F.col("k") == F.col("first"), "left").join(F.broadcast(total))
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("k", (running / F.col("total")).cast("double").alias("recall"))


def nested_results(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question: hit_min_rank, all_hits and ctxs by rank, both empty where nothing was found (K1)."""
    ctx = F.struct("rank", F.col("doc_id").alias("id"), "score", "has_answer")
    rows = hits.groupBy("qid").agg(F.array_sort(F.collect_list(ctx)).alias("ctxs"))
    rows = questions.join(rows, "qid", "left").withColumn("ctxs", F.coalesce("ctxs", F.array()))
    rows = rows.withColumn("all_hits", F.transform(F.filter("ctxs", lambda c: c["has_answer"]), lambda c: c["rank"]))
    return rows.withColumn("hit_min_rank", F.array_min("all_hits"))


def rescored(nested: DataFrame, passages: DataFrame) -> DataFrame:
    """First hits anew from stored contexts (A46). nested(qid, answers, ctxs)."""
    rows = nested.select("qid", "answers", F.explode("ctxs").alias("c")).select("qid", F.col("c.id").alias("doc_id"), F.col("c.rank").alias("rank"), F.col("c.score").alias("score"))
    return first_hits(matched(rows, passages, nested.select("qid", "answers")), nested)


def exact_match(prediction, gold):
    return (normalize_answer(prediction) == normalize_answer(gold)).cast("double")


def _occurrences(tokens):
    """Tokens in order, each with how many equal ones stand before it: what makes a multiset a set. Runs of equal
    tokens are found by their starts, so the work grows with the tokens."""

    def counted(a):
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)), lambda i: i.isNotNull())
        run = lambda s, i, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(s, j + 1), F.size(a)) - i - 1), lambda k: F.concat(F.get(a, i), F.lit(MARK), k.cast("string")))
        return bound(starts, lambda s: F.flatten(F.transform(s, lambda i, j: run(s, i, j))))

    return bound(F.sort_array(tokens), counted)


def overlap_f1(prediction, gold):
    """F1 of the token multisets of two answers."""
    both = F.struct(words(normalize_answer(prediction)).alias("p"), words(normalize_answer(gold)).alias("g"))

    def f1(x):
        same = F.size(F.array_intersect(_occurrences(x["p"]), _occurrences(x["g"])))
        return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(x["p"]) + F.size(x["g"])))

    return bound(both, f1)


def best_over_answers(rows: DataFrame, scorer, prediction: str = "prediction", answers: str = "answers") -> DataFrame:
    return rows.withColumn("score", F.array_max(F.transform(answers, lambda a: scorer(F.col(prediction), a))))


def best_overlap_f1(prediction, answers):
    """The best overlap_f1 over answers, all already normalised (A19): tokens are counted, once a prediction."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def best(predictions: pd.Series, many: pd.Series) -> pd.Series:
        from collections import Counter

        def one(p, answers):
            if p is None or answers is None:
                return None
            p, found = Counter(filter(None, p.split(" "))), []
            for a in answers:
                if a is not None:
                    g = Counter(filter(None, a.split(" ")))
                    same = sum((p & g).values())
                    found.append(2.0 * same / (p.total() + g.total()) if same else 0.0)
            return max(found, default=None)

        return pd.Series([one(p, a) for p, a in zip(predictions, many, strict=True)], dtype="float64")

    return best(prediction, answers)


def order_agreement(lists: DataFrame, k: int) -> DataFrame:
    """For lists(qid, ranks array: gold ranks in the order shown): inversions, overlap of the first k, and
    how many shown cover the gold first k (A20)."""
    n = F.size("ranks")
    inversions = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.size(F.filter(F.slice("ranks", i, n), lambda x: x < F.element_at("ranks", i))),
    )
    overlap = F.size(F.filter(F.slice("ranks", 1, k), lambda x: x < k)) / F.lit(float(k))
    cover = F.array_max(F.transform(F.col("ranks"), lambda x, i: F.when(x < k, i + 1)))
    return lists.select("qid", inversions.cast("bigint").alias("inversions"), overlap.alias("overlap"), cover.cast("bigint").alias("cover"))
