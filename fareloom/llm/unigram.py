"""Token counts under a unigram model, by dynamic programming shared over a trie.

A pre-token's tokens are the segmentation into vocabulary pieces with the largest sum of
log probabilities. The distinct pre-tokens of a batch are taken in sorted order, which walks
their trie without building it: a stack holds the forward scores (best sum, and number of
pieces) up to each node of the path, so a prefix that pre-tokens share is scored once. Counts
are stored by pre-token; the only trie that is built is that of the vocabulary.

Defined cases: a null text is empty and has 0 tokens; among equal scores the fewest pieces
win; every single byte is a piece, so every text can be cut; equal rows get equal results;
further columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.bpe import PATTERN
from fareloom.llm.common import slices


def zipf_scores(path: str) -> dict[bytes, float]:
    """Pieces of a rank file (base64 piece, rank) with log probabilities by Zipf's law.

    Rank files hold no probabilities, so piece number r gets one in proportion to
    1 / (r + 1); bytes that have no line of their own come after the last rank.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, filter(bytes.strip, f))}
    for b in range(256):
        ranks.setdefault(bytes([b]), len(ranks))
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(r + 1) - total for piece, r in ranks.items()}


class Counter:
    """The vocabulary as a trie, and the counts of pre-tokens seen lately."""

    cached = 400_000  # entries of each of two generations; only speed depends on it

    def __init__(self, scores: dict[bytes, float]):
        # pieces read backwards: from a node's end, all pieces that end there are one walk
        self.pieces: dict = {}
        for piece, score in scores.items():
            node = self.pieces
            for b in reversed(piece):
                node = node.setdefault(b, {})
            node[-1] = score
        self.new, self.old = {}, {}
        self.split = regex.compile(PATTERN).findall

    def count(self, words: list[bytes]) -> None:
        """Puts the counts of distinct pre-tokens into the cache.

        Sorted words visit the trie's nodes in depth-first order, so that the scores of the
        current path are a stack: what the next word shares with the last one stays.
        """
        words = sorted(words)
        best, used, last = [0.0], [0], b""
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], used[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                node, start, top, count = self.pieces, end, -math.inf, 0
                while start and (node := node.get(word[start - 1])) is not None:
                    start -= 1
                    if (own := node.get(-1)) is not None:
                        total = best[start] + own
                        if total > top or total == top and used[start] < count:
                            top, count = total, used[start] + 1
                        elif total == top:
                            count = min(count, used[start] + 1)
                best.append(top)
                used.append(count)
            self.new[word] = used[-1]
            last = word

    def of(self, texts: list[str]) -> list[int]:
        cut = [list(map(str.encode, self.split(t))) for t in texts]
        if len(self.new) >= self.cached:
            self.old, self.new = self.new, {}
        distinct = set().union(*cut)
        missing = []
        for word in distinct:
            if word not in self.new:
                if (known := self.old.get(word)) is not None:
                    self.new[word] = known
                else:
                    missing.append(word)
        self.count(missing)
        got = [sum(map(self.new.__getitem__, words)) for words in cut]
        for word in missing:  # long ones hardly come again
            if len(word) > 64:
                del self.new[word]
        return got


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, scores: dict[bytes, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: the number of unigram tokens of each whole text.

    ``scores`` (piece to log probability) must hold all single bytes; at most a few million.
    """
    if any(bytes([b]) not in scores for b in range(256)):
        raise ValueError("the vocabulary must hold every single byte")
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    key = zlib.crc32(repr(sorted(scores.items())).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:  # later tasks of the worker find it ready
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(shared.value)
        counter = _COUNTERS[key]
        for part in slices(batches, 1, 4 << 20):
            texts = [t or "" for t in part.column(1).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.of(texts), pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).schema)
