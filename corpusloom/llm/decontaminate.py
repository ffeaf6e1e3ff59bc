"""Benchmark decontamination with an FM-index per shard of the corpus.

Every scan task cuts its documents into shards of bounded size. A shard's words become
symbols: a number for each word that the test phrases hold, and one separator for a run
of other words and between documents (no phrase crosses those). Over the symbols stands
an FM-index: suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet
matrix for rank queries, and suffix positions sampled every SAMPLE symbols. All phrases
are searched backward at once, every match is located by walking to a sampled position,
and the word ranges of the matches are merged into spans to remove.

The phrases are the windows of WINDOW consecutive words of each item; an item of fewer
words, but not none, is one window. They are sent to the tasks in blocks of bounded size
(very long items in overlapping rows). A task searches each of its shards for one block
after the other and holds one block at a time, so the corpus is read once whatever the
number of blocks; nothing is shuffled.

Words: A-Z lower-cased, then runs of characters other than ASCII non-alphanumerics.

Defined results: null or empty text has no words; items without words have no windows;
items of equal id count as one, and those without an id as one with an empty id; every row
gives a row, repeated rows and null doc_ids included; items are ordered by id; an empty
table gives no rows; other columns pass through, but for n_words, ranges and items, which
the results replace (``remove`` leaves them as they are).
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op7_decontaminate"
WINDOW = 10
#: Bytes of item texts that one pass sends to every task.
BLOCK_BYTES = 4 << 20
#: Words of an item that one row of a block holds at most; longer items go in rows that overlap by a window.
ITEM_WORDS = 1 << 13
#: Symbols and words after which a shard is closed.
SHARD_SYMBOLS, SHARD_WORDS = 1 << 19, 1 << 22
#: Bytes of text after which a shard is closed where there are several blocks, for each of which it is read again.
SHARD_BYTES = 16 << 20
SAMPLE = 16
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULTS = ("n_words", "ranges", "items")
RESULT_DDL = "n_words bigint, ranges array<struct<start:bigint,stop:bigint>>, items array<string>"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    """The words, in UTF-8; all characters beyond ASCII are word characters, so bytes do as well."""
    return text.translate(_FOLD).split() if text else []


class Phrases:
    """Windows of items as sorted matrices of symbols, by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.symbol: dict[bytes, int] = {}
        self.names: list[str] = []
        number: dict[str, int] = {}
        of_length: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for item, text in items:
            ids = np.array([self.symbol.setdefault(w, len(self.symbol) + 2) for w in words_of(text)], np.int32)
            if len(ids):
                n = min(window, len(ids))
                found = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows, owners = of_length.setdefault(n, ([], []))
                rows.append(found)
                owners.append(np.full(len(found), number.setdefault(item, len(number)), np.int32))
        self.names = list(number)
        self.sigma = len(self.symbol) + 2
        #: (length, distinct windows, where each one's owners begin, owners as numbers in names)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted(of_length):
            rows, owners = (np.concatenate(x) for x in of_length.pop(n))
            order = np.lexsort((owners, *(rows[:, k] for k in range(n - 1, -1, -1))))
            rows, owners = rows[order], owners[order]
            new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))
            own = new | np.concatenate(([True], owners[1:] != owners[:-1]))
            starts = np.concatenate(([0], np.cumsum(own)))[np.append(np.flatnonzero(new), len(rows))]
            self.by_length.append((n, rows[new], starts, owners[own]))

    def owners(self, at: int, window: int) -> list[str]:
        _, _, starts, owners = self.by_length[at]
        return [self.names[k] for k in owners[starts[window] : starts[window + 1]].tolist()]


def suffix_order(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of s, whose last symbol is the only smallest one."""
    n, bits = len(s), max(1, int(sigma - 1).bit_length())
    take = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(take):
        key <<= bits
        if k < n:
            key[: n - k] |= s[k:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    # places in the order whose suffixes are not yet told apart
    alone = head & np.concatenate((head[1:], [True]))
    open_ = np.flatnonzero(~alone)
    k = take
    while len(open_):
        at = order[open_]
        pair = (rank[at] << 32) | rank[np.minimum(at + k, n - 1)]
        way = np.argsort(pair, kind="stable")
        at, pair = at[way], pair[way]
        order[open_] = at
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = open_[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        alone = head & np.concatenate((head[1:], [True]))
        open_ = open_[~alone]
        k *= 2
    return order


class FMIndex:
    """Counts and locates symbol strings in s (symbols from 1; a 0 is put behind it)."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.append(s, 0).astype(np.int64)
        n = len(s)
        order = suffix_order(s, sigma)
        bwt = s[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))[: sigma + 1]
        # the wavelet matrix: at each level the bits, as counts of zeros before each place
        self.levels, self.bits = [], max(1, int(sigma - 1).bit_length())
        at = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (at >> level) & 1
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.levels.append((level, zeros, int(zeros[n])))
            at = np.concatenate((at[bit == 0], at[bit == 1]))
        kept = order % sample == 0
        self.kept_before = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.kept = order[kept]
        self.is_kept = kept
        self.n = n

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first row entries of the transform."""
        lo, hi = np.zeros_like(row), row
        for level, zeros, total in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            zl, zh = zeros[lo], zeros[hi]
            lo, hi = np.where(one, total + lo - zl, zl), np.where(one, total + hi - zh, zh)
        return hi - lo

    def step(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer to the left."""
        symbol, lo, hi = np.zeros_like(row), np.zeros_like(row), row
        at = row
        for _, zeros, total in self.levels:
            za = zeros[at]
            one = zeros[at + 1] == za
            symbol = (symbol << 1) | one
            zl = zeros[lo]
            lo, at = np.where(one, total + lo - zl, zl), np.where(one, total + at - za, za)
        return self.first[symbol] + at - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase numbers, first rows, past-last rows) of those that occur; phrases is a matrix."""
        live = np.arange(len(phrases))
        phrases = phrases.astype(np.int64, copy=False)
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            found = lo < hi
            live, lo, hi = live[found], lo[found], hi[found]
            if not len(live):
                break
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in s of the suffixes in these rows."""
        out, todo, walked = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            here = self.is_kept[rows]
            done = todo[here]
            out[done] = self.kept[self.kept_before[rows[here]]] + walked
            todo, rows = todo[~here], self.step(rows[~here])
            walked += 1
        return out


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For intervals [lo, hi): all members, and the interval of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


def shard_hits(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Merged word ranges and items of each document, given as arrays of symbols (0: a word of no phrase)."""
    starts = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
    text = np.ones(starts[-1], np.int64)  # 1: separator, one behind each document
    for d, at in zip(docs, starts, strict=False):
        text[at : at + len(d)] = np.where(d, d, 1)
    keep = (text > 1) | np.concatenate(([True], text[:-1] > 1))
    place = np.flatnonzero(keep)
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    index = FMIndex(text[place], phrases.sigma)
    cover = np.zeros(len(text) + 1, np.int64)
    hit = False
    for which_length, (length, matrix, _, _) in enumerate(phrases.by_length):
        live, lo, hi = index.search(matrix)
        if not len(live):
            continue
        hit = True
        rows, which = _runs(lo, hi)
        at = place[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, w in np.unique(np.stack((doc, live[which])), axis=1).T.tolist():
            items[d].update(phrases.owners(which_length, w))
    if hit:
        inside = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(starts, begin, side="right") - 1
        for d, b, e in zip(doc.tolist(), (begin - starts[doc]).tolist(), (end - starts[doc]).tolist(), strict=True):
            spans[d].append((b, e))
    return spans, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _loaded(blocks: list):
    """The blocks one after the other; where there are several, none stays in memory behind its turn."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def _kernel(blocks: list, names: list[str], cut: bool = False):
    """Hits of all blocks (broadcasts) for each shard in turn. The columns of names pass through; with cut, alone, and text
    without the hits."""

    def run(batches):
        several = len(blocks) > 1
        get = None if several else blocks[0].value.symbol.get
        parts, docs, counts, symbols, n_words, n_bytes = [], [], [], 0, 0, 0

        def flush():
            spans, items = [[] for _ in counts], [set() for _ in counts]
            for block in _loaded(blocks):
                shard = docs if not several else [_symbols(block.symbol.get, words_of(t)) for p in parts for t in common.raw_texts(p.column("text"))]
                new_spans, new_items = shard_hits(shard, block)
                spans = [merged(a + b) if a and b else a or b for a, b in zip(spans, new_spans, strict=True)]
                items = [a | b for a, b in zip(items, new_items, strict=True)]
            at = 0
            for part in parts:
                n = part.num_rows
                new_spans, new_items = spans[at : at + n], items[at : at + n]
                if cut:
                    text = part.column("text")
                    new = [without(t, r) if r else t for t, r in zip(text.to_pylist(), new_spans, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(new, text.type) if c == "text" else part.column(c) for c in names], names)
                else:
                    ranges = pa.array([[{"start": b, "stop": e} for b, e in r] for r in new_spans], _RANGES)
                    found = pa.array([sorted(x) for x in new_items], pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(counts[at : at + n], pa.int64()), ranges, found], [*names, *RESULTS])
                at += n

        for part in common.slices(batches, "text"):
            for text in common.raw_texts(part.column("text")):
                words = words_of(text)
                if several:  # symbols differ from block to block
                    symbols += len(words)
                    n_bytes += len(text or b"")
                else:
                    docs.append(_symbols(get, words))
                    symbols += int(np.count_nonzero(docs[-1]))
                counts.append(len(words))
                n_words += len(words)
            parts.append(part if several else part.select(list(names)))
            if symbols >= SHARD_SYMBOLS * (8 if several else 1) or n_words >= SHARD_WORDS or n_bytes >= SHARD_BYTES:
                yield from flush()
                parts, docs, counts, symbols, n_words, n_bytes = [], [], [], 0, 0, 0
        if parts:
            yield from flush()

    return run


def _symbols(get, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(get, words, repeat(0)), np.int64, len(words))


def _item_kernel(window: int):
    """Items as rows of at most ITEM_WORDS words that overlap by a window less one word."""

    def run(batches):
        for part in common.slices(batches, "text"):
            items, numbers, texts = [], [], []
            for item, text in zip(part.column("item").to_pylist(), common.raw_texts(part.column("text")), strict=True):
                words = words_of(text)
                for k, at in enumerate(range(0, len(words), ITEM_WORDS)):
                    if at and len(words) - at < window:
                        break  # the row before has its windows, by the overlap
                    items.append(item)
                    numbers.append(k)
                    texts.append(b" ".join(words[at : at + ITEM_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary())], ["item", "number", "text"])

    return run


def blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The items in blocks of about block_bytes, dealt by hash, each collected by itself."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    items = common.materialize(items.mapInArrow(_item_kernel(window), "item string, number int, text binary"), "items")
    size = items.agg(F.sum(F.octet_length("text") + 32).alias("n")).first()["n"] or 0
    many = max(1, -(-size // block_bytes))
    for k in range(many):
        rows = items.where(F.pmod(F.xxhash64("item", "number", "text"), F.lit(many)) == k) if many > 1 else items
        yield [(r["item"], bytes(r["text"])) for r in rows.collect()]
    common.forget(items)


def _sent(context, phrases: Phrases):
    """A broadcast that the driver doesn't keep a copy of in its own process."""
    out = context.broadcast(phrases)
    out.__dict__.pop("_value", None)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """The columns of keep, n_words, ranges (merged hit word ranges) and items (ids whose windows occur) for every row of docs;
    with cut, the columns of keep alone, and text without the hits. Columns called like the results give way to them."""
    context = docs.sparkSession.sparkContext
    sent = [_sent(context, Phrases(b, window)) for b in blocks(benchmark, window, block_bytes)]
    names = [c for c in keep if cut or c not in RESULTS]
    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    docs = docs.select(*(f"`{c}`" for c in dict.fromkeys((*names, "text"))))
    return docs.mapInArrow(_kernel(sent, names, cut), fields if cut else f"{fields}, {RESULT_DDL}")


def without(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """The text without the words of the ranges and what stands between them."""
    if not ranges or not text:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, stop in ranges:
        out.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return "".join(out) + text[at:]


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the hit spans cut out of text; all rows and columns stay."""
    return contamination(docs, benchmark, window, tuple(docs.columns), cut=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda acc, r: acc + r["stop"] - r["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, least(len(w), 10) as n, w[i : i + 9] as p from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, i, w[i : i + n - 1] as p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.p = bw.p and dw.n = bw.n),
cover as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hits) group by doc_id),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover on d.doc_id = cover.doc_id left join found on d.doc_id = found.doc_id
"""
