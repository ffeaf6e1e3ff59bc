"""Language identification with a linear-chain conditional random field.

Words of a text are labelled jointly: emissions from affix, character n-gram and lexicon
features (hashed), learned transitions between neighbouring words, marginals by
forward-backward over chains of CHAIN words. A text's language is the label with the most
posterior mass over all its words, and its score the mean posterior of that label.

Training is on a bounded sample of labelled texts: about SAMPLE_DOCS per language of at most
SAMPLE_BYTES, picked by hash over the whole table, and SAMPLE_WORDS words of their lines. Lines of the sample are shuffled into chains that
change language on the way, so transitions are learned from code-switched sequences.
The conditional log-likelihood is maximised by adaptive gradient steps.

Words are runs of letters, lower-cased, cut after LONGEST. Emissions of known words are remembered
by each worker, so the cost of features falls on new words only.

Defined results: null text or text without letters gives lang_pred "und" and score 0; a
null doc_id counts as the empty string in the fold; with no labelled row to learn from,
every text is "und"; every row gives a row, repeated rows too; equal rows count once in
training; ties go to the smaller label; an empty table gives no rows; columns pass through,
but for those called lang_pred or score, which the results replace.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op5_language_id"
UNKNOWN = "und"
FOLDS = 5
#: Words per language that training uses at most, and the hash space of features.
SAMPLE_WORDS, DIMS = 60_000, 1 << 17
#: Documents per language that are looked at for them, on average, and their longest in bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 1 << 18
CHAIN = 64
EPOCHS, RATE, DECAY = 30, 0.1, 1e-6
#: Share of a feature's log odds that training starts from; a word's features overlap.
START = 0.15
#: Most frequent words of a language that form its lexicon.
LEXICON = 4_000
#: Words whose emissions a worker remembers.
MEMO = 250_000
#: Letters after which a longer run is cut into a further word, so every letter of unspaced scripts counts.
LONGEST = 40
_RUNS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST).findall
SCHEMA = "lang_pred string, score double"
RESULTS = ("lang_pred", "score")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and the marks that join them; runs without any letter are none."""
    return [w for w in _RUNS(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str, lexicon: frozenset | set) -> list[int]:
    """Hashed affix, n-gram and lexicon features of a word."""
    w = f"^{word}$"
    out = {f"p{w[:k]}" for k in (2, 3, 4)} | {f"s{w[-k:]}" for k in (2, 3, 4)}
    out |= {w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)}
    if word in lexicon:
        out.add(f"w{word}")
    return [zlib.crc32(f.encode()) % DIMS for f in out]


def feature_table(words, lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words in one array, and how many each has."""
    flat, sizes = array("i"), array("i")
    for w in words:
        found = features(w, lexicon)
        flat.extend(found)
        sizes.append(len(found))
    return np.frombuffer(flat, np.int32), np.frombuffer(sizes, np.int32).astype(np.int64)


def summed(weights: np.ndarray, flat: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Per word and label the sum of its features' weights; one label at a time bounds memory."""
    return np.stack([np.add.reduceat(np.ascontiguousarray(weights[:, j])[flat], heads) for j in range(weights.shape[1])], axis=1)


def forward_backward(emit: np.ndarray, trans: np.ndarray, begin: np.ndarray, live: np.ndarray):
    """Posteriors of chains of equal length. emit: (steps, chains, labels) positive weights;
    live: (steps, chains), False behind a chain's end. Also the log of the partition sums."""
    steps, chains, labels = emit.shape
    emit = np.where(live[:, :, None], emit, 1.0)
    alpha = np.empty_like(emit)
    scale = np.zeros(chains)
    at = begin * emit[0]
    for t in range(steps):
        if t:
            moved = (at @ trans) * emit[t]
            at = np.where(live[t][:, None], moved, at)
        total = at.sum(axis=1, keepdims=True)
        at = at / total
        scale += np.log(total[:, 0])
        alpha[t] = at
    beta = np.empty_like(emit)
    back = np.ones((chains, labels), emit.dtype)
    for t in range(steps - 1, -1, -1):
        beta[t] = back
        moved = (emit[t] * back) @ trans.T
        back = np.where(live[t][:, None], moved, back)
        back = back / back.sum(axis=1, keepdims=True)
    post = alpha * beta
    return post / post.sum(axis=2, keepdims=True), alpha, beta, scale


def chains_of(ids: np.ndarray, length: int = CHAIN):
    """ids cut into chains: (steps, chains) of ids, and which are live."""
    n = max(1, -(-len(ids) // length))
    out = np.full(n * length, -1, np.int64)
    out[: len(ids)] = ids
    out = out.reshape(n, length).T
    return out, out >= 0


class CRF:
    def __init__(self, labels: list[str], lexicon: frozenset, weights: np.ndarray, trans: np.ndarray, begin: np.ndarray):
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.trans, self.begin = weights, trans, begin

    def emission(self, words: list[str]) -> np.ndarray:
        """Log weights (words, labels)."""
        if not words:
            return np.zeros((0, len(self.labels)))
        flat, sizes = feature_table(words, self.lexicon)
        return summed(self.weights, flat, np.cumsum(sizes) - sizes)

    @classmethod
    def train(cls, texts: list[tuple[str, str]], sample_words: int = SAMPLE_WORDS, epochs: int = EPOCHS) -> CRF | None:
        """texts: (language, text) of the sample."""
        labels = sorted({lang for lang, _ in texts})
        if not labels:
            return None
        rng = np.random.default_rng(7)
        number = {lang: i for i, lang in enumerate(labels)}
        every, lines, used = [], [], [0] * len(labels)
        counts: list[dict[str, int]] = [{} for _ in labels]
        for lang, text in texts:
            for line in text.split("\n"):
                words = words_of(line)
                every += [(number[lang], words[i : i + 24]) for i in range(0, len(words), 24)]
        for k in rng.permutation(len(every)):
            lang, part = every[k]
            if used[lang] < sample_words:
                used[lang] += len(part)
                lines.append((lang, part))
                for w in part:
                    counts[lang][w] = counts[lang].get(w, 0) + 1
        if not lines:
            return None
        lexicon = frozenset(w for c in counts for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON])
        words, tokens, gold = {}, [], []
        for lang, part in lines:
            for w in part:
                tokens.append(words.setdefault(w, len(words)))
                gold.append(lang)
        flat, sizes = feature_table(words, lexicon)
        heads = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ids, live = chains_of(np.array(tokens))
        want, _ = chains_of(np.array(gold))
        n, m = len(tokens), len(labels)
        one = np.zeros((*want.shape, m))
        np.put_along_axis(one, np.maximum(want, 0)[:, :, None], 1.0, axis=2)
        one *= live[:, :, None]
        pairs = live[1:] & live[:-1]
        gold_pairs = np.einsum("tci,tcj->ij", one[:-1] * pairs[:, :, None], one[1:])
        weights, trans, begin = np.zeros((DIMS, m)), np.zeros((m, m)), np.zeros(m)
        # start from the log odds of features
        per = np.stack([np.bincount(owner_of, minlength=len(words)) for owner_of in (np.array(tokens)[np.array(gold) == j] for j in range(m))], axis=1)
        seen = np.stack([np.bincount(flat, weights=per[owner, j], minlength=DIMS) for j in range(m)], axis=1)
        odds = np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5))
        weights += START * np.where(seen.sum(axis=1, keepdims=True) > 0, odds - odds.mean(axis=1, keepdims=True), 0)
        memory = [np.full_like(x, 1e-8) for x in (weights, trans, begin)]
        for _ in range(epochs):
            emission = summed(weights, flat, heads)
            emit = np.exp(emission - emission.max(axis=1, keepdims=True))[np.maximum(ids, 0)]
            t, b = np.exp(trans), np.exp(begin)
            post, alpha, beta, _ = forward_backward(emit, t, b, live)
            by_word = np.zeros((len(words), m))
            np.add.at(by_word, ids[live], (one - post)[live])
            grad_w = np.stack([np.bincount(flat, weights=by_word[owner, j], minlength=DIMS) for j in range(m)], axis=1)
            both = alpha[:-1][:, :, :, None] * t * (emit[1:] * beta[1:])[:, :, None, :]
            both = both / both.sum(axis=(2, 3), keepdims=True)
            grad_t = gold_pairs - (both * pairs[:, :, None, None]).sum(axis=(0, 1))
            grad_b = (one[0] - post[0]).sum(axis=0)
            for x, g, mem in ((weights, grad_w, memory[0]), (trans, grad_t, memory[1]), (begin, grad_b, memory[2])):
                g = g / n - DECAY * x
                mem += g * g
                x += RATE * g / np.sqrt(mem)
        return cls(labels, lexicon, weights.astype(np.float32), np.exp(trans), np.exp(begin))


class Predictor:
    """Labels texts with a CRF; remembers the emissions of words."""

    def __init__(self, model: CRF):
        self.model, self.place = model, {}
        self.table = np.zeros((0, len(model.labels)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        model = self.model
        found = [words_of(t) if t else [] for t in texts]
        if len(self.place) > MEMO:
            self.place, self.table = {}, np.zeros((0, len(model.labels)))
        new = list({w for ws in found for w in ws}.difference(self.place))
        if new:
            emission = model.emission(new)
            start = len(self.place)
            self.place.update(zip(new, range(start, start + len(new)), strict=True))
            self._grow(start, np.exp(emission - emission.max(axis=1, keepdims=True)))
        get = self.place.__getitem__
        ids, live, doc = [], [], []
        for k, ws in enumerate(found):
            if ws:
                i, ok = chains_of(np.fromiter(map(get, ws), np.int64, len(ws)))
                ids.append(i)
                live.append(ok)
                doc += [k] * i.shape[1]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if doc:
            all_ids, all_live = np.concatenate(ids, axis=1), np.concatenate(live, axis=1)
            mass = np.zeros((len(texts), len(model.labels)))
            for at in range(0, len(doc), 1024):  # bounds memory for long texts
                i, ok = all_ids[:, at : at + 1024], all_live[:, at : at + 1024]
                post = forward_backward(self.table[np.maximum(i, 0)], model.trans, model.begin, ok)[0]
                np.add.at(mass, doc[at : at + 1024], (post * ok[:, :, None]).sum(axis=0))
            for k, ws in enumerate(found):
                if ws:
                    best = int(np.argmax(mass[k]))
                    langs[k], scores[k] = model.labels[best], float(min(1.0, mass[k, best] / len(ws)))
        return langs, scores

    def _grow(self, start: int, rows: np.ndarray) -> None:
        need = start + len(rows)
        if need > len(self.table):
            bigger = np.zeros((max(need, 2 * len(self.table), 65_536), rows.shape[1]))
            bigger[:start] = self.table[:start]
            self.table = bigger
        self.table[start:need] = rows


def _kernel(model, names: list[str], key: str):
    def run(batches):
        predictor = common.kept(f"language model {key}", lambda: Predictor(model.value)) if model is not None else None
        for part in common.slices(batches, "text"):
            texts = part.column("text").to_pylist()
            langs, scores = predictor.predict(texts) if predictor else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return run


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> CRF | None:
    """A model of the labelled rows outside the held-out fold: per language about sample_docs
    documents by hash of doc_id and text, of which sample_words words are used."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    h = F.xxhash64("doc_id", "text")
    share = F.lit(False)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, common.sampled(h, sample_docs, n)).otherwise(share)
    picked = known.where(share & (F.octet_length("text") <= SAMPLE_BYTES))
    rows = picked.select("lang", "text", h.alias("h")).dropDuplicates(["lang", "h"]).collect()
    return CRF.train([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["h"], r["text"]))], sample_words)


def identify(docs: DataFrame, model: CRF | None, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all by default) and lang_pred, score for every row of docs. Only text is looked at; columns of docs
    that are called like the results give way to them."""
    names = [n for n in keep or docs.columns if n not in RESULTS]
    sent = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*dict.fromkeys((*names, "text"))).mapInArrow(_kernel(sent, names, uuid.uuid4().hex), f"{fields}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, learn(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
