"""Byte-pair encoding and decoding.

A pre-token becomes a doubly linked list of symbols; a priority queue holds the ranks of
adjacent pairs, and entries whose pair no longer stands are skipped when they come up. The
ids of a text are kept as little-endian unsigned 32-bit integers; decoding concatenates the
vocabulary's byte strings.

Defined cases: a null text is empty and has no ids; a text is always encoded whole, however
long; special strings in a text become their ids; equal rows give equal results; further
columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import slices

#: The byte-level pre-token pattern of such vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 34  # bits for a position in a queue entry


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merge ranks and a cache of encoded pre-tokens for one worker."""

    cached = 250_000  # entries of each of two generations; only speed depends on it

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocab = {token: i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for token, i in vocab.items():
            self.token[i] = as_bytes(token)
        for token, i in self.special.items():
            self.token[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.new, self.old = {}, {}

    def pieces(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        merge, heap = self.merge, []
        for i in range(n - 1):
            if (found := merge.get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append(found[0] << SHIFT | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << SHIFT) - 1)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue  # merged away, or nothing on its right any more
            found = merge.get(ids[i] << 32 | ids[j])
            if found is None or found[0] != entry >> SHIFT:
                continue  # the pair at this place has changed since
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (right := merge.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, right[0] << SHIFT | i)
            if (h := before[i]) >= 0 and (left := merge.get(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, left[0] << SHIFT | h)
        return [x for x in ids if x >= 0]

    def packed(self, word: str) -> bytes:
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = np.array(self.pieces(word.encode()), "<u4").tobytes()
            if len(word) <= 64:  # longer ones hardly come again
                if len(self.new) >= self.cached:
                    self.old, self.new = self.new, {}
                self.new[word] = found
        return found

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.packed, self.split(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(raw: bytes) -> Codec:
    """The worker's codec of this vocabulary; later tasks of the worker find it ready."""
    key = zlib.crc32(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and sent to the workers (a few MB at most)."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"{path}: too large for a vocabulary")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as little-endian 32-bit integers."""
    raw = _vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for part in slices(batches, 1):
            ids = [codec.encode(x) if x else b"" for x in part.column(1).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.col("text").alias("ids")).schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, text``: the ids back as text."""
    raw = _vocabulary(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for part in slices(batches, 1):
            texts = pa.array([codec.decode(x) for x in part.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, rows.withColumn("text", F.lit("")).schema)
