"""Token counts by byte-pair merging with a heap over a linked list.

A text becomes symbols (characters, spaces written as U+2581, one U+2581 in front).
The pair of neighbours whose concatenation has the best score in the vocabulary is
popped from a heap, leftmost first among equals, and merged; the count is the initial
symbols less the merges, where a character that the vocabulary lacks stands for its
UTF-8 bytes. No identifiers are produced.

No piece of such a vocabulary has U+2581 after another character, so no merge crosses
the start of a run of spaces; a text is therefore counted chunk by chunk (a run of
spaces and the word after it) and the count of a chunk is remembered. Vocabularies for
which this does not hold are counted without chunks. A line break that occurs in no
longer piece also ends a chunk.

Defined results: null or empty text has 0 bytes and 0 tokens; every row gives a row,
repeated doc_ids included; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

NAME = "op2_token_counts"
LIMIT = 4096
SPACE = "▁"
#: Chunks whose counts a worker remembers.
MEMO = 500_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback and identity normaliser does."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        split = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        lines = split and not any("\n" in p for p in self.score if len(p) > 1)
        self.chunks = re.compile(" *[^ \n]+|\n| +" if lines else " *[^ ]+| +" if split else r"(?s).+").findall
        self.memo: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        """Initial symbols of the chunk less its merges."""
        score = self.score
        symbols = list(chunk.replace(" ", SPACE))
        n = len(symbols)
        count = sum(1 if c in score else len(c.encode()) for c in symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, symbols[i] + symbols[i + 1]))
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            # a symbol that was merged away or grew since makes the entry stale
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            count -= 1
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                both = pair + symbols[k]
                s = score.get(both)
                if s is not None:
                    heappush(heap, (-s, i, both))
            h = before[i]
            if h >= 0:
                both = symbols[h] + pair
                s = score.get(both)
                if s is not None:
                    heappush(heap, (-s, h, both))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo, total = self.memo, 0
        for c in self.chunks(" " + text.replace(SPACE, " ")):
            n = memo.get(c)
            if n is None:
                n = self.merged(c)
                if len(memo) < MEMO and len(c) <= 64:  # frequent chunks come early
                    memo[c] = n
            total += n
        return total


def _kernel(model_file: str, limit: int):
    def run(batches):
        counter = common.kept(f"pieces {model_file}", lambda: PieceCounter(model_file))
        for part in common.slices(batches, "text"):
            texts = part.column("text").to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            n_tokens = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text). One narrow pass, no shuffle."""
    return docs.select(docs["doc_id"].cast("bigint"), "text").mapInArrow(_kernel(model_file, limit), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
