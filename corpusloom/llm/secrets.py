"""Secret scans by grammar inference.

Labelled credentials (matches of the base patterns in a bounded sample of documents) are
put into one prefix tree per kind over character classes; states whose outgoing
frequencies are statistically compatible (Hoeffding bound, tested along all common
continuations) are merged, red states against blue, into a probabilistic automaton with
the frequencies of characters within each class. A further automaton of the same make is
learned from ordinary tokens of the sample, less those that score like credentials. Every
candidate token of every whole text is then scored by its log-likelihood under the best
kind's automaton less that under the ordinary one, per character; a threshold taken from
the labelled tokens decides. Candidates are the maximal runs of SHORTEST or more of the
characters that an assigned credential may have, whatever they are made of.

The base spans always stay; a scored span is added where it overlaps none of them.

Defined results: null or empty text has no spans; every row gives a row, repeated rows and
null doc_ids included; spans that begin together are ordered by kind; where the sample
holds fewer than LEAST credentials of a kind, that kind has no automaton and adds nothing;
an empty table gives no rows; other columns of the input are ignored, or pass through redact.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NAME = "op8_secret_scan"
#: Documents whose tokens are learned from, on average (any number of documents in the table), and the credentials and ordinary tokens kept of them per kind.
SAMPLE_DOCS, SAMPLE_TOKENS = 20_000, 400
#: Tasks that a kind's sample is dealt to.
SHARES = 32
#: Credentials of a kind below which nothing is learned.
LEAST = 20
#: Significance of the test for compatible states.
ALPHA = 0.1
#: Shortest candidate token, as long as the shortest labelled credential.
SHORTEST = 6
#: Tokens whose kind a worker remembers.
MEMO = 300_000
#: Share of the ordinary tokens below the threshold; credentials among the others do not move it.
ORDINARY = 0.99

# The base patterns of the contract, group 2 of 6+, 20+ and 24+ characters.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_PLAIN = ("password", "passwd", "secret", "token", "apikey", "api_key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = re.compile("(" + _EITHER + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Tokens that may be credentials.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
VALUE = re.compile(r"""[=:"']*([A-Za-z0-9+/_.-].*?)=*$""").match

SPANS_DDL = "array<struct<kind:string,start:bigint,stop:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    # the pattern is only run where one of its words is
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(w in low for w in _PLAIN) else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def credential(kind: str, text: str) -> str:
    return ASSIGN.match(text)[2] if kind == "assign" else text


def _class(c: str) -> str:
    return "0" if c.isdigit() else "a" if c in "abcdef" else "g" if c.islower() else "A" if c.isupper() else c


class Automaton:
    """A probabilistic automaton over character classes, inferred by state merging."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.root = math.sqrt(0.5 * math.log(2 / alpha))
        # the prefix tree: visits, ends and children of each state
        self.visits, self.ends, self.next = [0], [0], [{}]
        chars: Counter = Counter()
        for w in words:
            at = 0
            self.visits[0] += 1
            for c in w:
                chars[c] += 1
                k = _class(c)
                if k not in self.next[at]:
                    self.next[at][k] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                at = self.next[at][k]
                self.visits[at] += 1
            self.ends[at] += 1
        self._infer()
        of_class: Counter = Counter()
        for c, n in chars.items():
            of_class[_class(c)] += n
        size = {"0": 10, "a": 6, "g": 20, "A": 26}
        self.char = {c: math.log((n + 0.5) / (of_class[_class(c)] + 0.5 * size.get(_class(c), 1))) for c, n in chars.items()}
        self.other = {k: math.log(0.5 / (n + 0.5 * size.get(k, 1))) for k, n in of_class.items()}
        self.step = [self._logs(s) for s in range(len(self.visits))]
        self.table = [_State(self, s) for s in range(len(self.visits))]

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.root * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if self._differ(na, self.ends[a], nb, self.ends[b]):
                return False
            for k in self.next[a].keys() | self.next[b].keys():
                x, y = self.next[a].get(k), self.next[b].get(k)
                fx, fy = (self.count[a].get(k, 0), self.count[b].get(k, 0))
                if self._differ(na, fx, nb, fy):
                    return False
                if x is not None and y is not None:
                    todo.append((x, y))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for k, y in self.next[b].items():
                self.count[a][k] = self.count[a].get(k, 0) + self.count[b][k]
                if k in self.next[a]:
                    todo.append((self.next[a][k], y))
                else:
                    self.next[a][k] = y

    def _infer(self) -> None:
        self.count = [{k: self.visits[t] for k, t in n.items()} for n in self.next]
        red = [0]
        while True:
            reds = set(red)
            blue = sorted({(-self.visits[t], t, s, k) for s in red for k, t in self.next[s].items() if t not in reds})
            if not blue:
                break
            _, t, s, k = blue[0]
            for r in red:
                if self._compatible(r, t):
                    self.next[s][k] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        self.red = red

    def _logs(self, s: int) -> dict[str, tuple[float, int]]:
        total = sum(self.count[s].values()) + self.ends[s]
        return {k: (math.log((n + 0.1) / (total + 1)), self.next[s][k]) for k, n in self.count[s].items()}

    def score(self, word: str) -> float:
        """Mean log-likelihood of a character; a class that the state never saw costs a rare event and keeps the state."""
        at, total = self.table[0], 0.0
        for c in word:
            log, at = at[c]
            total += log
        return total / max(1, len(word))


class _State(dict):
    """What each character costs in a state, and the state it leads to; filled as characters come."""

    def __init__(self, automaton: Automaton, number: int):
        self.automaton, self.number = automaton, number

    def __missing__(self, c: str):
        a, k = self.automaton, _class(c)
        log, to = a.step[self.number].get(k, (-7.0, self.number))
        out = log + (a.char.get(c) or a.other.get(k, -4.0)), a.table[to]
        if c.isascii():
            self[c] = out
        return out

    def __reduce__(self):
        return _State, (self.automaton, self.number)


class Model:
    """One automaton per kind, that of ordinary tokens, and the threshold."""

    def __init__(self, positives: dict[str, list[str]], negatives: list[str]):
        self.kinds = {k: Automaton(words) for k, words in positives.items() if len(words) >= LEAST}
        self.ordinary = Automaton(negatives or ["a"])
        self.memo: dict[str, tuple[str, int, int] | None] = {}
        own = sorted(self.best(w)[0] for k in self.kinds for w in positives[k])
        if own:
            # tokens that look more like credentials than a quarter of the labelled ones are unlabelled credentials:
            # the ordinary automaton is inferred again without them
            negatives = [w for w in negatives if self.best(w)[0] < max(0.0, own[len(own) // 4])]
            self.ordinary = Automaton(negatives or ["a"])
            own = sorted(self.best(w)[0] for k in self.kinds for w in positives[k])
        other = sorted(self.best(w)[0] for w in negatives) if self.kinds else []
        self.threshold = max([0.0, *own[len(own) // 50 : len(own) // 50 + 1], *(x + 1e-9 for x in other[max(0, int(ORDINARY * len(other)) - 1) :][:1])])

    def best(self, word: str) -> tuple[float, str]:
        base = self.ordinary.score(word)
        return max(((a.score(word) - base, k) for k, a in self.kinds.items()), default=(-math.inf, ""))

    def hit(self, token: str) -> tuple[str, int, int] | None:
        """The kind of a token and where its value is in it; None for an ordinary one."""
        found = self.memo.get(token, token)
        if found is token:
            found, v = None, VALUE(token)
            if v and len(v[1]) >= SHORTEST:
                score, kind = self.best(v[1])
                found = (kind, *v.span(1)) if score >= self.threshold else None
            if len(self.memo) < MEMO and len(token) <= 64:  # frequent tokens come early
                self.memo[token] = found
        return found


def tokens(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidate tokens (value, start, stop) that overlap none of the taken spans."""
    out = []
    spans = sorted((s, e) for _, s, e in taken)
    at, reach = 0, 0
    for m in TOKEN.finditer(text):
        # tokens come in order: reach is the furthest end of the spans that begin before this token's end
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start():
            v = VALUE(m[0])
            if v and len(v[1]) >= SHORTEST:
                out.append((v[1], m.start() + v.start(1), m.start() + v.end(1)))
    return out


def all_spans(text: str | None, model: Model) -> list[tuple[str, int, int]]:
    """Base and added spans by start, then kind in the order base kinds, learned kinds."""
    if not text:
        return []
    found = base_spans(text)
    every, hit = TOKEN.findall(text), model.hit
    if any([hit(t) for t in set(every)]):  # only then the places are looked for
        free, at, reach, new = sorted((s, e) for _, s, e in found), 0, 0, []
        for m in TOKEN.finditer(text):
            while at < len(free) and free[at][0] < m.end():
                reach = max(reach, free[at][1])
                at += 1
            if reach <= m.start() and (k := hit(m[0])):
                new.append((f"learned_{k[0]}", m.start() + k[1], m.start() + k[2]))
        found += new
    return sorted(found, key=lambda x: (x[1], _RANK[x[0]]))


_RANK = {k: i for i, k in enumerate((*KINDS, *(f"learned_{k}" for k in KINDS)))}


def _sample_kernel(many: int):
    """Labelled credentials and ordinary tokens of a task: per kind the `many` distinct ones smallest by hash."""

    def run(batches):
        kept: dict[str, set] = {k: set() for k in (*KINDS, "ordinary")}
        limit = dict.fromkeys(kept, 1 << 32)

        def add(kind: str, word: str) -> None:
            h = zlib.crc32(word.encode("utf-8", "replace"))
            if h <= limit[kind]:
                kept[kind].add((h, word))
                if len(kept[kind]) >= 4 * many:
                    kept[kind] = set(sorted(kept[kind])[:many])
                    limit[kind] = max(kept[kind])[0]

        for part in common.slices(batches, "text"):
            for text in part.column("text").to_pylist():
                if text:
                    found = base_spans(text)
                    for k, s, e in found:
                        add(k, credential(k, text[s:e])[:256])
                    for v, _, _ in tokens(text, found):
                        add("ordinary", v[:256])
        rows = [(k, w, h) for k in kept for h, w in sorted(kept[k])[:many]]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("kind", "word", "h"))}, schema=pa.schema([("kind", pa.string()), ("word", pa.string()), ("h", pa.int64())]))

    return run


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Model:
    """The model of a bounded sample of docs: about sample_docs documents by hash of their rows,
    of their distinct tokens the sample_tokens smallest by hash per kind, cut to 256 characters."""
    picked = docs.where(common.sampled(F.xxhash64("doc_id", "text"), sample_docs, docs.count()))
    found = picked.select("text").mapInArrow(_sample_kernel(sample_tokens), "kind string, word string, h bigint")
    # the smallest of each share of a kind hold the smallest of the kind; no kind is one task's alone
    rank = F.dense_rank().over(Window.partitionBy("kind", F.col("h") % SHARES).orderBy("h", "word"))
    words: dict[str, set[tuple[int, str]]] = {k: set() for k in (*KINDS, "ordinary")}
    for row in found.withColumn("rank", rank).where(F.col("rank") <= sample_tokens).select("kind", "h", "word").distinct().collect():
        words[row["kind"]].add((row["h"], row["word"]))
    picked = {k: sorted(w for _, w in sorted(v)[:sample_tokens]) for k, v in words.items()}
    return Model(picked, picked.pop("ordinary"))


def _sent(docs: DataFrame, model: Model):
    """The model as a broadcast, and a name by which workers keep it and what they learn of tokens."""
    return docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex


def _scan_kernel(sent, key: str):
    def run(batches):
        model = common.kept(f"secrets {key}", lambda: sent.value)
        for part in common.slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "stop"), x, strict=True)) for x in all_spans(t, model)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, _SPAN)], ["doc_id", "spans"])

    return run


def secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, spans (code points, end exclusive) for every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(_scan_kernel(*_sent(docs, model or learn(docs))), f"doc_id bigint, spans {SPANS_DDL}")


def masked(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every maximal run of overlapping spans replaced by the mark."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, stop in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join(out) + text[at:]


def _mask_kernel(sent, key: str, names: list[str]):
    def run(batches):
        model = common.kept(f"secrets {key}", lambda: sent.value)
        for part in common.slices(batches, "text"):
            new = [masked(t, all_spans(t, model)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, part.schema.field("text").type) if n == "text" else part.column(n) for n in names], names)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked; all rows and columns stay."""
    return docs.mapInArrow(_mask_kernel(*_sent(docs, learn(docs.select("doc_id", "text"))), docs.columns), docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(common.table(spark, sf_dir, "documents"))
    many = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(many(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*KINDS))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
