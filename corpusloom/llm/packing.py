"""Best-fit packing by hierarchical residual rounds.

A document's token ids (and the end id) are cut, only if longer than a sequence, into
pieces. Every scan task packs its own pieces best-fit, longest first: full and nearly full
bins are closed at once, and only underfull bins travel on, as items of their fill level.
They are dealt to groups of about GROUP_ROWS bins, packed best-fit again, and so on
with other groups until one round closes less than one bin in SETTLED or one group is
left. A group never holds more than GROUP_ROWS bins on average, whatever the input.

Defined results: null text is an empty text (its only id is the end id); every row is a
document of its own, repeated and null doc_ids included; documents of equal length keep the
order of their task; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op10_best_fit_packing"
CAPACITY = 2048
END_ID = 0
#: A bin with no more room than this is closed in the first round. Later rounds close only full bins early.
NEARLY = 8
#: Underfull bins that one task packs in a merging round.
GROUP_ROWS = 20_000
#: Merging stops when a round saves less than one bin in this many.
SETTLED = 200
#: Words whose ids a worker remembers.
MEMO = 350_000

PIECE = pa.struct(
    [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("text_no", pa.int64())]
)
BINS = pa.schema([("bin", pa.int64()), ("fill", pa.int64()), ("closed", pa.bool_()), ("items", pa.list_(PIECE))])
BINS_DDL = (
    "bin bigint, fill bigint, closed boolean, "
    "items array<struct<doc_id:bigint,piece:bigint,start:bigint,length:bigint,ids_crc32:bigint,text_no:bigint>>"
)


class WordIds:
    """Ids (little-endian unsigned 32-bit) of a text by a tokenizer file that drops white space and cuts
    the rest into letters, single digits and other runs before merging. Words are looked up
    once and remembered; a text with a character or string for which that is not known to be
    the same goes to the library whole."""

    LETTERS = "a-z\\u00df-\\u00f6\\u00f8-\\u012f\\u0131-\\u0148\\u014a-\\u017e"
    PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e" + "A-Z\\u00c0-\\u00d6\\u00d8-\\u00de" + LETTERS + "]*").fullmatch
    WORDS = re.compile("[" + LETTERS + "]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s0-9" + LETTERS + "]+").findall

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's own core only
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        #: For each id whether it ends a word; None where the vocabulary doesn't mark that.
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in encoded)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words: many in one text, cut where a word ends."""
        out = []
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            if self.ends is not None:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stops) == len(some) and stops[-1] == len(ids):
                    raw = ids.tobytes()
                    out += [raw[4 * b : 4 * e] for b, e in zip([0, *stops], stops)]
                    continue
            out += self._library(some)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        plain, rest, get = {}, [], self.memo.get
        gaps: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if self.PLAIN(t) and not any(s in t for s in self.special):
                words = self.WORDS(t.lower())
                ids = list(map(get, words))
                plain[k] = words, ids
                if None in ids:
                    gaps[k] = [i for i, x in enumerate(ids) if x is None]
            else:
                rest.append(k)
        new = list({plain[k][0][i] for k, at in gaps.items() for i in at})
        found = dict(zip(new, self._words(new), strict=True))
        for k, at in gaps.items():
            words, ids = plain[k]
            for i in at:
                ids[i] = found[words[i]]
        for k, (_, ids) in plain.items():
            out[k] = b"".join(ids)
        if len(self.memo) < MEMO:  # frequent words come early; what comes when it is full is not kept
            self.memo.update(found)
        for k, ids in zip(rest, self._library([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of indices) of a best-fit packing, longest first; ties keep the input's order.
    Room left is one of capacity + 1 values, so open bins are kept in a list per value."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the values that have open bins, sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            if not by_room[left]:
                rooms.insert(bisect_left(rooms, left), left)
            by_room[left].append(b)
    return bins


def _packed(items: list[list[dict]], fills: list[int], capacity: int, nearly: int, base: int) -> pa.RecordBatch:
    bins = best_fit(fills, capacity)
    rows = {"bin": [], "fill": [], "closed": [], "items": []}
    for k, members in enumerate(bins):
        fill = sum(fills[i] for i in members)
        rows["bin"].append(base + k)
        rows["fill"].append(fill)
        rows["closed"].append(capacity - fill <= nearly)
        rows["items"].append([x for i in members for x in items[i]])
    return pa.RecordBatch.from_pydict(rows, schema=BINS)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _first_round(path: str, capacity: int, end_id: int, nearly: int):
    def run(batches):
        words, tail, task, seen, base = common.kept(f"ids {path}", lambda: WordIds(path)), end_id.to_bytes(4, "little"), _task(), 0, 0
        items, fills = [], []
        for part in common.slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                ids += tail
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    items.append([{"doc_id": doc_id, "piece": p, "start": at // 4, "length": len(piece) // 4, "ids_crc32": zlib.crc32(piece), "text_no": (task << 32) + seen}])
                    fills.append(len(piece) // 4)
                seen += 1
            if len(items) > GROUP_ROWS:
                yield _packed(items, fills, capacity, nearly, (task << 32) + base)
                base += len(items)
                items, fills = [], []
        if items:
            yield _packed(items, fills, capacity, nearly, (task << 32) + base)

    return run


def _merge_round(capacity: int, nearly: int, level: int):
    def run(batches):
        items, fills = [], []
        for part in batches:
            items += part.column("items").to_pylist()
            fills += part.column("fill").to_pylist()
        if items:
            yield _packed(items, fills, capacity, nearly, (level << 56) + (_task() << 32))

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(bin, fill, closed, items): the sequences, each with its pieces in order, over docs(doc_id, text)."""
    bins = docs.select(docs["doc_id"].cast("bigint"), "text").mapInArrow(_first_round(tokenizer_file, capacity, end_id, NEARLY), BINS_DDL)
    bins = common.materialize(bins, "pack-0")
    done = bins.where("closed")
    level, left = 0, bins.where("not closed")
    count = left.count()
    while count > 1:
        level += 1
        groups = -(-count // GROUP_ROWS)
        dealt = left.repartition(groups, F.xxhash64("bin", F.lit(level))) if groups > 1 else left.coalesce(1)
        # bins with little room are only closed for good once they are in the last round or full
        bins = common.materialize(dealt.mapInArrow(_merge_round(capacity, 0, level), BINS_DDL), f"pack-{level}")
        done = done.unionByName(bins.where("closed"))
        left = bins.where("not closed")
        now = left.count()
        if groups == 1 or (count - now) * SETTLED < count:
            break
        count = now
    return done.unionByName(left)


def pieces(bins: DataFrame) -> DataFrame:
    """One row per piece with its place: sequence_id and offset."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("offsets"))
    starts = F.aggregate(
        "items",
        zero,
        lambda acc, x: F.struct((acc["at"] + x["length"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets")),
    )["offsets"]
    return bins.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("items", starts.alias("offset"))).alias("x")).select(
        "x.items.doc_id", F.col("x.items.piece").cast("int").alias("piece"), "x.items.start", "x.items.length", "x.items.ids_crc32", "sequence_id", "x.offset"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
