"""Top-k vector search. Embeddings are an input column.

Exact search multiplies Arrow batches of the corpus with blocks of queries: a block is at
most QUERY_BYTES, checked, so it may be sent to every task whatever the number of
queries; each batch returns its own k best per query, and a group-limited window merges
them. Scores are compared at SCALE digits, ties by doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vector as V
from corpusloom.lineage import materialize
from corpusloom.shipping import ship

from .ranking import ranked

QUERY_BYTES = 64 << 20
SCALE = 9


def _query_blocks(queries: DataFrame, dims_bytes: int = QUERY_BYTES):
    """The queries in blocks by hash, each collected by itself."""
    row = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not row["n"]:
        return
    many = -(-row["n"] * max(1, row["d"] or 1) * 8 // dims_bytes)
    for k in range(many):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(many)) == k) if many > 1 else queries
        rows = part.select("qid", V.doubles("embedding").alias("e")).collect()
        if rows:
            yield np.array([r["qid"] for r in rows]), np.array([r["e"] for r in rows], np.float64)


def _scores(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """(rows of x, rows of q), larger is closer."""
    if kind == "cos_sim":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    if kind in ("cos_sim", "dot"):
        s = x @ q.T
    elif kind == "euclidean":
        s = -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * x @ q.T, 0))
    else:
        s = np.stack([-np.abs(x - r).sum(1) for r in q], axis=1)
    return np.where(np.isnan(s), -1.0, s)


def _probed_scores(x: np.ndarray, cells: np.ndarray, q: np.ndarray, kind: str, probed: np.ndarray) -> np.ndarray:
    """Scores of the cells that a query probes; all others are minus infinity and are not computed."""
    s = np.full((len(x), len(q)), -np.inf)
    for c in np.unique(cells):
        rows, cols = np.flatnonzero(cells == c), np.flatnonzero(probed[:, c])
        if len(cols):
            s[np.ix_(rows, cols)] = _scores(x[rows], q[cols], kind)
    return s


#: Rows and queries whose score matrix is held at once: 8 MB in doubles.
ROW_TILE, QUERY_TILE = 1024, 1024


def _tiles(batches, q: np.ndarray, books: list[np.ndarray] | None = None):
    """(vectors, ids, batch) of at most ROW_TILE rows, read without a Python number per component; with codebooks, rows hold
    codes and are decoded here."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROW_TILE):
            part = batch.slice(at, ROW_TILE)
            x = part.column("e").flatten().to_numpy(zero_copy_only=False)
            if books is None:
                x = x.astype(np.float64).reshape(part.num_rows, q.shape[1])
            else:
                codes = x.reshape(part.num_rows, len(books))
                x = np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)
            yield x, part.column("doc_id").to_numpy(zero_copy_only=False), part


def best_of_rows(s: np.ndarray, live: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k largest live scores in s (rows, queries), ties by doc_id; all queries at once."""
    s = np.where(live, s, -np.inf).T
    if s.shape[1] > k:
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        picked = (s >= cut[:, None]) & live.T
    else:
        picked = live.T
    q, r = np.nonzero(picked)
    order = np.lexsort((docs[r], -s[q, r], q))
    q, r = q[order], r[order]
    start = np.searchsorted(q, q)  # of each entry the first of its query
    kept = np.arange(len(q)) - start < k
    return q[kept], r[kept]


def _kernel(block, k: int, kind: str, exclude_self: bool, threshold: float | None):
    def run(batches):
        ids, q, probed, books = block.value
        for x, docs, part in _tiles(batches, q, books):
            for at in range(0, len(ids), QUERY_TILE):
                some, mine = q[at : at + QUERY_TILE], ids[at : at + QUERY_TILE]
                if probed is None:
                    s = np.round(_scores(x, some, kind), SCALE)
                    live = np.ones(s.shape, bool)
                else:
                    s = np.round(_probed_scores(x, part.column("cell").to_numpy(zero_copy_only=False), some, kind, probed[at : at + QUERY_TILE]), SCALE)
                    live = s > -np.inf
                if exclude_self:
                    live &= docs[:, None] != mine[None, :]
                if threshold is not None:
                    live &= s >= threshold
                j, r = best_of_rows(s, live, docs, k)
                yield pa.RecordBatch.from_arrays([pa.array(mine[j]), pa.array(docs[r]), pa.array(s[r, j])], ["qid", "doc_id", "score"])

    return run


def exact_search(queries: DataFrame, corpus: DataFrame, k: int, score: str = "cos_sim", exclude_self: bool = False, threshold: float | None = None) -> DataFrame:
    """run(qid, doc_id, score, rank) of queries(qid, embedding) over corpus(doc_id, embedding).
    A threshold is applied before the cut to k; the result is the same after it (P7)."""
    if score not in V.SCORES:
        raise ValueError(f"no such score: {score}; one of {sorted(V.SCORES)}")
    rows = corpus.where("embedding is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), V.doubles("embedding").alias("e"))
    return _search(queries, rows, k, score, exclude_self, threshold)


def _search(queries: DataFrame, rows: DataFrame, k: int, score: str, exclude_self: bool, threshold: float | None = None, probe=None, books: list[np.ndarray] | None = None) -> DataFrame:
    """The search over rows(doc_id, e), or, with probe(query vectors) -> (queries, cells) of bool, over rows(doc_id, e, cell).
    With codebooks e holds a row's codes."""
    spark = rows.sparkSession
    ship(spark)
    out = None
    for ids, vectors in _query_blocks(queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding")):
        sent = spark.sparkContext.broadcast((ids, vectors, None if probe is None else probe(vectors), books))
        part = rows.mapInArrow(_kernel(sent, k, score, exclude_self, threshold), "qid bigint, doc_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "qid bigint, doc_id bigint, score double")
    return ranked(out, k)


def _count_kernel(sent):
    def run(batches):
        ids, q, best, best_id = sent.value
        for x, docs, _ in _tiles(batches, q):
            for at in range(0, len(ids), QUERY_TILE):
                some = slice(at, at + QUERY_TILE)
                s = np.round(_scores(x, q[some], "cos_sim"), SCALE)
                other = (docs[:, None] != best_id[None, some]) & (docs[:, None] != ids[None, some])
                n = (other & ((s > best[some]) | ((s == best[some]) & (docs[:, None] < best_id[some])))).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n)], ["qid", "n"])

    return run


def own_ranks(queries: DataFrame, corpus: DataFrame, own: DataFrame) -> DataFrame:
    """(qid, r) for every query: the rank by cosine of its best own(qid, doc_id) document in the whole corpus,
    the number of documents and one where it has none there. A query's own row does not count. Better documents are
    counted in blocks, none is cut off."""
    spark = corpus.sparkSession
    ship(spark)
    queries = queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding")
    rows = corpus.where("embedding is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), V.doubles("embedding").alias("e"))
    pairs = queries.select("qid", V.doubles("embedding").alias("q")).join(own, "qid").join(rows, "doc_id")
    best = pairs.select("qid", "doc_id", F.round(V.SCORES["cos_sim"](F.col("q"), F.col("e")), SCALE).alias("s"))
    best = best.groupBy("qid").agg(F.max_by("doc_id", F.struct("s", -F.col("doc_id"))).alias("doc_id"), F.max("s").alias("s"))
    found = None
    for ids, vectors in _query_blocks(queries.join(best, "qid", "left_semi")):
        known = {r["qid"]: r for r in best.join(spark.createDataFrame([(int(i),) for i in ids], "qid bigint"), "qid").collect()}
        sent = spark.sparkContext.broadcast((ids, vectors, np.array([known[i]["s"] for i in ids]), np.array([known[i]["doc_id"] for i in ids])))
        part = rows.mapInArrow(_count_kernel(sent), "qid bigint, n bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "qid bigint, n bigint")
    ranks = found.groupBy("qid").agg((F.sum("n") + 1).alias("r"))
    return queries.select("qid").join(ranks, "qid", "left").select("qid", F.coalesce("r", F.lit(rows.count() + 1)).alias("r"))


def score_pairs(pairs: DataFrame, a: str, b: str, score: str = "cos_sim") -> Column:
    return V.SCORES[score](V.doubles(a), V.doubles(b))


def binary_search(queries: DataFrame, corpus: DataFrame, k: int, binary_k: int = 1000, threshold: float = 0.0) -> DataFrame:
    """Two stages (V10): the binary_k nearest by Hamming distance of sign bits, then those by the inner product of
    the query with the document's signs. The inner product of two sign vectors is their length less twice the distance,
    so the first stage is a search in blocks like any other."""
    signs = lambda df: df.withColumn("embedding", F.transform(V.doubles("embedding"), lambda x: F.when(x > threshold, 1.0).otherwise(-1.0)))
    run = exact_search(signs(queries), signs(corpus), binary_k, "dot", exclude_self=True)
    return rerank_own(run, queries, signs(corpus), binary_k, V.dot).where(F.col("rank") <= k)


def _spread_kernel(sent, alpha: float, t: float):
    def run(batches):
        ids, q, labels = sent.value
        for x, docs, batch in _tiles(batches, q):
            mark = np.array(batch.column("label").to_pylist(), object)
            for at in range(0, len(ids), QUERY_TILE):
                d = -_scores(x, q[at : at + QUERY_TILE], "euclidean")
                other = docs[:, None] != ids[None, at : at + QUERY_TILE]
                near = other & (mark[:, None] == labels[None, at : at + QUERY_TILE])
                sums = (float((d[near] ** alpha).sum()), int(near.sum()), float(np.exp(-t * d[other] ** 2).sum()), int(other.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in sums], ["a", "na", "u", "nu"])

    return run


def alignment_uniformity(queries: DataFrame, corpus: DataFrame, alpha: float = 2.0, t: float = 2.0) -> DataFrame:
    """Mean distance^alpha of pairs of equal label, and ln mean exp(-t d^2) of all pairs, over the pairs of a query with another
    row of the corpus (A35). Blocks of queries meet batches of the corpus; only sums leave a task."""
    spark = corpus.sparkSession
    ship(spark)
    rows = corpus.where("embedding is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), V.doubles("embedding").alias("e"), "label")
    labels = queries.select(F.col("qid").cast("bigint").alias("qid"), "label")
    sums = None
    for ids, vectors in _query_blocks(queries.select(F.col("qid").cast("bigint").alias("qid"), "embedding")):
        known = {r["qid"]: r["label"] for r in labels.join(spark.createDataFrame([(int(i),) for i in ids], "qid bigint"), "qid").collect()}
        sent = spark.sparkContext.broadcast((ids, vectors, np.array([known[i] for i in ids.tolist()], object)))
        part = rows.mapInArrow(_spread_kernel(sent, alpha, t), "a double, na bigint, u double, nu bigint")
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        sums = spark.createDataFrame([], "a double, na bigint, u double, nu bigint")
    return sums.agg((F.sum("a") / F.nullif(F.sum("na"), F.lit(0))).alias("alignment"), F.ln(F.sum("u") / F.nullif(F.sum("nu"), F.lit(0))).alias("uniformity"))


def mips(vectors: DataFrame) -> DataFrame:
    """Vectors extended by sqrt(max|x|^2 - |x|^2) (V7): the nearest by distance are the largest by inner product."""
    v = vectors.withColumn("e", V.doubles("embedding"))
    top = v.agg(F.max(V.dot(F.col("e"), F.col("e"))).alias("top"))
    return v.join(F.broadcast(top)).withColumn("extended", V.mips_extended(F.col("e"), F.col("top"))).drop("e", "top")


def half_precision(vectors: DataFrame, digits: int = 3) -> DataFrame:
    """A scalar quantizer (V8): components rounded to a grid."""
    return vectors.withColumn("embedding", F.transform(V.doubles("embedding"), lambda x: F.round(x, digits)))


def ivf_search(queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None, share: float = 0.75, seed: int = 7, threshold: float | None = None) -> DataFrame:
    """Inverted file (V11): k-means cells, about the root of the corpus size and 16 at least where
    none are given; each query searches the share of the cells whose centres are nearest. Scores below a threshold are dropped."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = corpus.where("embedding is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), V.doubles("embedding").alias("e")).withColumn("features", array_to_vector("e"))
    model = KMeans(k=cells or max(16, round(data.count() ** 0.5)), seed=seed, maxIter=10).fit(data)
    centres = np.array(model.clusterCenters())
    probes = int(np.ceil(share * len(centres)))

    def probe(q):
        far = (centres * centres).sum(1)[None, :] - 2 * q @ centres.T
        near = np.argsort(far, axis=1, kind="stable")[:, :probes]
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    placed = model.transform(data).select("doc_id", "e", F.col("prediction").alias("cell"))
    return _search(queries, placed, k, "dot", True, threshold, probe)


def _refined(run: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, wide: int) -> DataFrame:
    """The first `wide` of an approximate run ranked by their exact inner products, and of those the first k."""
    return rerank_own(run, queries, corpus, wide, V.dot).where(F.col("rank") <= k)


def _code_kernel(sent):
    def run(batches):
        books = sent.value
        width = sum(book.shape[1] for book in books)
        for x, _, part in _tiles(batches, np.empty((0, width))):
            codes, at = np.empty((len(x), len(books)), np.int32), 0
            for p, book in enumerate(books):
                some = x[:, at : at + book.shape[1]]
                codes[:, p] = np.argmin((book * book).sum(1)[None, :] - 2 * some @ book.T, axis=1)
                at += book.shape[1]
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(books)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel()))], ["doc_id", "e"])

    return run


def pq_search(queries: DataFrame, corpus: DataFrame, k: int, parts: int = 16, codes: int = 128, wide: int = 200, seed: int = 7) -> DataFrame:
    """Product quantization (V6): a codebook per subspace, documents stored as codes. A query's inner product
    with the decoded document is the sum of its table look-ups; the first `wide` are ranked again exactly."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    ship(spark)
    data = corpus.where("embedding is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), V.doubles("embedding").alias("e"))
    dims = data.select(F.size("e").alias("d")).first()["d"]
    books = []
    for at in np.array_split(np.arange(dims), min(parts, dims)):
        part = data.select(array_to_vector(F.slice("e", int(at[0]) + 1, len(at))).alias("features"))
        books.append(np.array(KMeans(k=codes, seed=seed, maxIter=8).fit(part).clusterCenters()))
    sent = spark.sparkContext.broadcast(books)
    # codes are written: a stage then has one Python kernel, where coding, decoding and searching each had workers of their own
    coded = materialize(data.mapInArrow(_code_kernel(sent), "doc_id bigint, e array<int>"), "codes")
    run = _search(queries, coded, max(k, wide), "dot", True, books=books)
    return _refined(run, queries, corpus, k, max(k, wide))


def pca_search(queries: DataFrame, corpus: DataFrame, k: int, dims: int = 32, wide: int = 200) -> DataFrame:
    """PCA before exact search (V9); the first `wide` are ranked again by the whole vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = PCA(k=dims, inputCol="x", outputCol="y").fit(corpus.select(array_to_vector(V.doubles("embedding")).alias("x")))
    turn = lambda df: model.transform(df.withColumn("x", array_to_vector(V.doubles("embedding")))).withColumn("embedding", vector_to_array("y")).drop("x", "y")
    return _refined(exact_search(turn(queries), turn(corpus), max(k, wide), "dot", exclude_self=True), queries, corpus, k, max(k, wide))


def rerank_pool(queries: DataFrame, corpus: DataFrame, run: DataFrame, top: int, k: int, score: str = "cos_sim") -> DataFrame:
    """Every query searches the pool of all queries' first `top` documents."""
    pool = corpus.join(run.where(F.col("rank") <= top).select("doc_id").distinct(), "doc_id", "left_semi")
    return exact_search(queries, pool, k, score, exclude_self=True)


def rerank_own(run: DataFrame, queries: DataFrame, corpus: DataFrame, top: int, scorer) -> DataFrame:
    """Each query's own first documents scored anew by scorer(query column, document column)."""
    pairs = run.where(F.col("rank") <= top).select("qid", "doc_id")
    pairs = pairs.join(queries.select("qid", F.col("embedding").alias("q")), "qid").join(corpus.select("doc_id", F.col("embedding").alias("d")), "doc_id")
    return ranked(pairs.select("qid", "doc_id", F.round(scorer(V.doubles("q"), V.doubles("d")), SCALE).alias("score")))
