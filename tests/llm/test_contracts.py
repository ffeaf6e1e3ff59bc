"""Every registered query against its SQL or a plain twin: names, types and rows; and the odd cases for all operators."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, common, decontaminate, embedding_dup, language_id, license_scan, near_dup, packing, registry, secrets, token_count, warc
from corpusloom.shipping import ship

TYPES = {
    "op1_chat_format": "conv_id:bigint,n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint",
    "op2_token_counts": "doc_id:bigint,n_bytes:bigint,n_tokens:bigint,over_limit:boolean",
    "op3_embedding_near_dup": "vec_id:bigint,n_links:bigint,component_id:bigint,kept:boolean",
    "op4_warc_roundtrip": "page_id:bigint,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint",
    "op5_language_id": "doc_id:bigint,held_out:boolean,lang_pred:string,score:double",
    "op6_license_scan": "doc_id:bigint,n_sentences:bigint,n_known:bigint,n_rules:bigint,licences:string",
    "op7_decontaminate": "doc_id:bigint,n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,contaminated:boolean",
    "op8_secret_scan": "doc_id:bigint,n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string",
    "op9_minhash_near_dup": "doc_id:bigint,n_shingles:bigint,component_id:bigint,kept:boolean",
    "op10_best_fit_packing": "doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,sequence_id:bigint,offset:bigint",
}
SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark conversations".split()
LONG = " ".join(f"word{i % 997} number{i}" for i in range(10_000)) + " password=Xk3vQz9pLm AKIA" + "Q" * 16
TEXTS = [None, "", " ", "x²", "²³", "one", "Same text here, twice over.", "Same text here, twice over.", LONG, LONG + " end", "<|im_end|><|x", "Ünï " * 50, "a" * 30_000]


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    ship(spark)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with odd rows and with columns called like those that the operators use inside."""
    to = tmp_path_factory.mktemp("odd")
    clash = "key node score lang_pred ranges items spans component component_id kept digest refers_to tile sign hub parts size tree".split()
    put = lambda df, name: df.select("*", *(F.lit(1).alias(c) for c in clash if c not in df.columns)).write.parquet(f"{to}/{name}.parquet")
    put(spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string, n_chars bigint"), "documents")
    v = [1.0, 0.5, -2.0, 3.0]
    vectors = [v, v, [2 * x for x in v], None, [], [0.0] * 4, [float("nan"), *v[1:]], [None, *v[1:]], v[:3], [-x for x in v], v]
    put(spark.createDataFrame([(i, x, None if i == 10 else 1) for i, x in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int"), "embeddings")
    put(spark.createDataFrame([(i, None if i == 2 else f"http://p/{i}", t) for i, t in enumerate(TEXTS)], "page_id bigint, url string, html string"), "pages")
    put(spark.createDataFrame([(1, " ".join(LONG.split()[500:530])), (2, "one"), (3, None), (4, ""), (5, LONG)], "item_id bigint, text string"), "benchmark")
    turns = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate([(None, None), ("user", LONG), ("assistant", "<|im_end|>"), ("ro\nle", "")])]
    put(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), "conversations")
    return str(to)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        files = f"{sf}/{t}.parquet" if sf == SF else f"{sf}/{t}.parquet/*.parquet"
        con.execute(f"create view {t} as select * from '{files}'")
    got = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df_rows, names: sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in df_rows), key=repr)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("tables", ["given", "odd"])
def test_query_equals_its_sql(spark, odd, name, tables):
    same_as_sql(spark, name, SF if tables == "given" else odd)


@pytest.mark.parametrize("name", sorted(TYPES))
def test_query_names_and_types(spark, odd, name):
    df = registry.queries()[name](spark, odd)
    assert ",".join(f"{c}:{t}" for c, t in df.dtypes) == TYPES[name]
    if name not in registry.oracle_sql():
        assert df.count() >= len(TEXTS)


# --- plain twins -------------------------------------------------------------------------------
ASSIGNED = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain_base(text):
    text = text or ""
    found = [("assign", *m.span()) for m in ASSIGNED.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@pytest.mark.parametrize("tables", ["given", "odd"])
def test_secret_digests_equal_a_plain_twin(spark, odd, tables):
    sf = SF if tables == "given" else odd
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.queries()["op8_secret_scan"](spark, sf).collect():
        base = plain_base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("learned_")] == [x for x in joined.split(",") if x]
        for x in r["spans"].split(","):
            if x.startswith("learned_"):
                s, e = map(int, x.split(":")[1:])
                assert all(e <= b or z <= s for _, b, z in base) and e - s >= secrets.SHORTEST


def plain_licences(text):
    """Longest known run of pieces at every place, by trying all of them; then rules, longest first."""
    parts = re.split(r"(\n+|[.!?;:]+(?=\s|$))", text or "")
    pieces, colon = [], []
    for part, end in zip(parts[::2], [*parts[1::2], "."], strict=True):
        if s := license_scan.normalised(part):
            pieces.append(s)
            colon.append(end == ":")
        elif colon and end != ":":
            colon[-1] = False
    gapped = [(re.compile(re.escape(license_scan.normalised(f.split("*")[0])) + r"(?: \S+){1,16} " + re.escape(license_scan.normalised(f.split("*")[1]))), k) for k, f in license_scan._forms() if "*" in f]
    out, i, inside = [], 0, False
    while i < len(pieces):
        best, stop = None, i + 1
        for j in range(i + 1, min(len(pieces), i + 60) + 1):
            s = " ".join(pieces[i:j])
            k = license_scan.KNOWN.get(s) or next((k for p, k in gapped if p.fullmatch(s)), None)
            if k:
                best, stop = k, j
        if best or not inside:
            out.append(best)
        i, inside = stop, not best and colon[stop - 1]
    found, i = [], 0
    while i < len(out):
        fits = [(len(r), name) for name, rules in license_scan.RULES.items() for r in rules if out[i] and out[i : i + len(r)] == r]
        if fits:
            n, name = min(fits, key=lambda x: (-x[0], x[1]))
            found.append((name, i, n))
            i += n
        else:
            i += 1
    return out, found


def test_licences_equal_a_plain_twin(spark):
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    bsd = "All rights reserved.\nNeither the name of the A B nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + [notice, bsd, notice.replace(" ", "\n"), None, "", "MIT License: x. The MIT License"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license_scan.licences(docs).collect()}
    known = 0
    for i, t in enumerate(texts):
        ids, rules = plain_licences(t)
        assert got[i]["n_sentences"] == len(ids) and got[i]["sentence_ids"] == [k for k in ids if k], t
        assert [tuple(x) for x in got[i]["rules"]] == rules and got[i]["licences"] == sorted({x[0] for x in rules})
        known += len(rules)
    assert known > 5


# --- samples that hold at any size -------------------------------------------------------------
@pytest.mark.parametrize("total", [1, 300, 10**9, 10**11, 10**15])
def test_samples_never_become_empty(spark, total):
    hashes = spark.range(1).select(F.array(*(F.lit(int(h)) for h in (2**63 - 1) // 7 * np.arange(8))).alias("h"), F.lit(2**63 * 200 // max(total, 200) - 1).alias("inside"))
    row = hashes.select(F.exists("h", lambda h: common.sampled(h, 300, total)).alias("any"), common.sampled(F.col("inside"), 300, total).alias("inside"), F.forall("h", lambda h: common.sampled(h, 300, total)).alias("all")).first()
    assert row["any"] and row["inside"] and row["all"] == (total <= 300)


# --- repeated ids ------------------------------------------------------------------------------
def test_documents_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (7, b), (8, b + " c"), (9, "alone one"), (9, "alone one"), (9, "alone two"), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, extra int")
    got = sorted((tuple(r) for r in near_dup.near_duplicates(docs, 2).collect()), key=repr)
    want = [(1, 39, 1, True), (5, 39, 1, False), (5, 39, 1, False), (7, 39, 1, False), (8, 40, 1, False), (9, 1, 9, True), (9, 1, 9, True), (9, 1, 9, True), (None, 39, None, None), (None, 39, None, None)]
    assert got == sorted(want, key=repr)
    kept = near_dup.keep_one(docs, 2)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == [1, 9, None, None]


def test_vectors_with_repeated_ids_and_string_labels(spark):
    v, w = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(1, v, "x"), (1, v, "x"), (2, [2.0, 4.0, 6.1], "x"), (2, w, "x"), (3, v, "y"), (4, v, "x")]
    got = sorted(tuple(r) for r in embedding_dup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 1, False)])


def test_candidates_are_few(spark):
    """Pairs that some block lets through, of all pairs: random directions as the given vectors have them."""
    x = np.random.default_rng(1).normal(size=(1000, 64)).astype(np.float32)
    tile = embedding_dup.Tile([r.tobytes() for r in x], "<f4")
    assert np.triu(embedding_dup.candidates(tile, tile, slice(0, 1000), 0.93), 1).mean() < 0.01


def test_pages_with_repeated_ids_lose_no_payload(spark):
    rows = [(1, "u", "same"), (5, "u5", "same"), (5, "u5", "only here"), (None, "n", "same"), (5, "u5", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = common.scratch(spark, "warc")
    got = warc.read(warc.write(pages, folder), folder).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["payload"], r["refers_to"]) for r in got if r["payload"]) == [(0, "response", b"same", None), (1, "response", b"same", None), (5, "response", b"only here", None)]
    assert sum(r["record_type"] == "revisit" and r["refers_to"] == 1 for r in got) == 2


def test_revisits_name_the_record_of_their_response():
    payload = b"<p>"
    digest = warc.digest_of(payload)
    response, revisit = warc.record(3, "u", payload, digest, None).decode(), warc.record(9, "v", payload, digest, 3).decode()
    field = lambda text, name: re.search(rf"^{name}: (.*?)\r$", text, re.M)[1]
    assert field(revisit, "WARC-Refers-To") == field(response, "WARC-Record-ID") != field(revisit, "WARC-Record-ID")


def test_messages_with_repeated_nodes_and_null_trees(spark):
    rows = [("null", 1, None, "user", "a", 0.0), (None, 1, None, "user", "b", 0.0), ("t", 1, None, "user", "q", 0.0), ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "x", 0.0), ("t", None, 1, "user", "lost", 0.0)]
    got = chat.format_trees(spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double").withColumn("leaf", F.lit(7)))
    assert sorted((r["tree"] or "", r["n_turns"]) for r in got.collect()) == [("", 1), ("null", 1), ("t", 2)]


# --- all operators on odd documents ------------------------------------------------------------
def test_repeated_rows_and_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    twice = docs.unionByName(docs)
    n, bench = len(TEXTS), spark.read.parquet(f"{odd}/benchmark.parquet").select("item_id", "text")
    import public_tokenizers

    model = secrets.Model({}, [])
    per_row = {
        "tokens": lambda d: token_count.token_counts(d, public_tokenizers.path("piece_bpe_32k.model")),
        "licences": license_scan.licences,
        "secrets": lambda d: secrets.secrets(d, model),
        "redacted": secrets.redact,
        "hits": lambda d: decontaminate.contamination(d, bench, keep=tuple(d.columns)),
        "cleaned": lambda d: decontaminate.remove(d, bench),
        "languages": lambda d: language_id.identify(d, language_id.learn(d)),
        "groups": near_dup.near_duplicates,
    }
    for name, fn in per_row.items():
        df = fn(twice)
        assert len(set(df.columns)) == len(df.columns), name
        assert df.count() == 2 * n, name
        assert fn(docs.limit(0)).count() == 0, name
    pieces = packing.pieces(packing.pack(twice, public_tokenizers.path("word_bpe_49k.json")))
    assert pieces.where("piece = 0").count() == 2 * n
    odd_ids = spark.createDataFrame([(None, "some text here"), (None, None)], "doc_id bigint, text string")
    for name in ("tokens", "licences", "secrets", "hits", "groups"):
        assert per_row[name](odd_ids).count() == 2, name


def test_letters_decide(spark, odd):
    got = {r["doc_id"]: r for r in registry.queries()["op5_language_id"](spark, odd).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(6)] == [True, True, True, False, True, False]
    assert language_id.words_of("日" * 95 + " x²") == ["日" * 40, "日" * 40, "日" * 15, "x²"]


def test_decontamination_in_blocks_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 16)
    words = [f"w{i}" for i in range(100)]
    bench = spark.createDataFrame([("a", " ".join(words)), ("b", "w3 w4"), ("b", "zz"), (None, "yy")], "item_id string, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 14])) for i in range(87)] + [(100, "zz yy"), (101, "w1")], "doc_id bigint, text string")
    for block in (1 << 20, 100):
        got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench, block_bytes=block).collect()}
        assert all("a" in got[i]["items"] and [tuple(x) for x in got[i]["ranges"]] == [(0, 14)] for i in range(87))
        assert got[100]["items"] == ["", "b"] and got[101]["items"] == []


def test_pipeline_stages_on_odd_documents(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id in (5, 8)")).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        assert name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS, name
        assert out.count() > 0, name
        assert stage(spark, docs.limit(0), odd).count() == 0, name
    kept = corpus_pipeline.near_duplicates(spark, docs, odd)
    assert kept.where("doc_id = 8").count() == 1 and kept.where("doc_id = 9").count() == 0
