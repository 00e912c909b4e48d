"""Removal of repeated word sequences by prefix-partitioned suffix trees.

The suffixes of a shard are split by prefixes of variable length: a prefix held by too many
suffixes is lengthened word by word, and neighbouring small prefixes are put together, so
that each group fits a fixed amount of memory. Each group gets the suffix trees of its
prefixes, cut at the window's length; an internal node at that depth is a sequence that
starts at two places or more, and the suffixes below it start repeated windows.

``fareloom.llm.windows`` brings the segments that may repeat to shards of a few MB.

Defined cases: null texts and texts without words have none; matches never cross texts; rows
equal in id and text are texts of their own; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import SPACE, WordHashes, ragged_ranges, ragged_starts, row_key, slices
from fareloom.llm.windows import Windows, covered, touched

WINDOW = 35
GROUP = 4096  # suffixes in a group: with the window's words, about half a MB


def prefix_groups(words: np.ndarray, starts: np.ndarray, depth: int, limit: int) -> Iterator[np.ndarray]:
    """Groups of suffixes: whole prefixes together, at most ``limit`` suffixes unless equal up to ``depth``.

    Equal prefixes are never parted; a prefix with over ``limit`` suffixes is lengthened.
    """
    waiting = [(starts, 0)]
    while waiting:
        group, length = waiting.pop()
        if len(group) <= limit or length == depth:
            yield group
            continue
        head = words[group + length]
        order = np.argsort(head, kind="stable")
        group, head = group[order], head[order]
        first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        count = np.diff(np.append(first, len(group)))
        for k in np.flatnonzero(count > limit).tolist():
            waiting.append((group[first[k]:first[k] + count[k]], length + 1))
        few = count <= limit
        if not few.any():
            continue
        # small prefixes in order, put together up to the limit
        bins = np.zeros(int(few.sum()), np.int64)
        held = number = 0
        for k, c in enumerate(count[few].tolist()):
            if held + c > limit:
                number, held = number + 1, 0
            held += c
            bins[k] = number
        rows = group[ragged_ranges(first[few], count[few])]
        yield from np.split(rows, np.flatnonzero(np.diff(np.repeat(bins, count[few]))) + 1)


def internal_nodes(common: list[int]) -> list[tuple[int, int, int]]:
    """Depth, first and last leaf of the internal nodes of the trees over sorted suffixes.

    ``common[k]`` is the common prefix of the suffixes k and k + 1. Nodes open when a deeper
    prefix begins and close when it ends.
    """
    nodes, path = [], [(0, 0)]
    for leaf, depth in enumerate([*common, 0]):
        first = leaf
        while path[-1][0] > depth:
            deep, first = path.pop()
            nodes.append((deep, first, leaf))
        if depth > path[-1][0]:
            path.append((depth, first))
    return nodes


def repeated_windows(segments: list[bytes], times: np.ndarray, windows: np.ndarray, size: int = WINDOW, limit: int = GROUP) -> list[np.ndarray]:
    """For each segment (word hashes), which of its windows occur twice in the shard.

    Segment k stands for ``times[k]`` places; its first ``windows[k]`` positions start windows.
    """
    hashes = np.frombuffer(b"".join(segments), np.uint64)
    words = np.unique(hashes, return_inverse=True)[1].astype(">u4")  # big-endian: byte order is number order
    offsets = ragged_starts(np.array([len(s) // 8 for s in segments]))[:-1]
    weight = np.zeros(len(words), np.int64)
    starts = ragged_ranges(offsets, windows)
    weight[starts] = np.repeat(times, windows)
    marked = np.zeros(len(words), bool)
    for group in prefix_groups(words, starts, size, limit):
        rows = words[group[:, None] + np.arange(size)]
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{4 * size}").ravel(), kind="stable")
        group, rows = group[order], rows[order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), size) if len(group) > 1 else np.zeros(0, np.int64)
        marked[group[weight[group] > 1]] = True  # a leaf of two places
        for depth, first, last in internal_nodes(common.tolist()):
            if depth >= size:
                marked[group[first:last + 1]] = True
    return [marked[o:o + n] for o, n in zip(offsets.tolist(), windows.tolist())]


def _words_of() -> Callable[[bytes], np.ndarray]:
    known = WordHashes()
    return lambda text: known.of(text.split())


def normal_words(text: Column) -> Column:
    """The words of a text joined by one blank."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "))


def removed(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_key, n_removed, kept``: the texts that lose words, and the words left, joined by one blank."""
    windows = Windows(size, gram=max(1, size * 10 // 35), fine_gram=max(1, size * 4 // 5))
    index = lambda segments, times, n: repeated_windows(segments, times, n, size)
    found = touched(docs, _words_of, index, windows, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            counts, kept = [], []
            for body, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                words = body.split()
                gone = covered(len(words), spans, size)
                counts.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                                             ["row_key", "n_removed", "kept"])

    return found.mapInArrow(run, "row_key binary, n_removed long, kept binary")


def remove(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``; texts that lose words come back as their other words joined by blanks."""
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("row_key"))
    result = rows.join(removed(docs, size, doc_id, text), "row_key", "left")
    body = F.coalesce(F.col("kept").cast("string"), F.col("row")[text].cast("string"))
    return result.select(*[(body.alias(c) if c == text else F.col("row")[c].alias(c)) for c in docs.columns])
