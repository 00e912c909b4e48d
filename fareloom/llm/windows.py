"""Windows that occur more than once in a corpus: what the two substring removers share.

A text is a sequence of items (bytes, or hashes of words); a window is ``size`` consecutive
items. Two texts with an equal window are found without comparing texts:

1. A window's key is the smallest hash of the grams inside it, so equal windows have equal
   keys, and consecutive windows mostly share theirs: a *run* is a stretch of windows of one
   text with one key. Runs are a small fraction of the windows.
2. Keys that occur once are dropped: their windows are unique. Counting moves hashes only,
   folded in each task first.
3. A remaining run becomes a *segment*, the items of its windows. Equal segments are folded
   into one with a count, so groups of copies of any size cost one segment; what is left of
   a key goes to one task, where an index over the segments finds the windows that occur
   twice. A key with very many runs is refined by a second, longer gram before that. One that
   still has very many distinct segments is never gathered: its segments are taken apart into
   single windows, told by 128-bit digests and counted by a partial aggregate.
4. The marks go back to every place of a segment and from there to the texts.

Every window of the corpus belongs to exactly one segment, and equal windows always meet in
one task, so the result is exact whatever the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import mixed, ragged_ranges, ragged_starts, release, row_key, slices, stored

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
LONGEST = 2048  # windows in a segment; longer runs are split


@dataclass(frozen=True)
class Windows:
    """Window size, gram lengths for keys and refined keys, and how many runs make a key hot.

    A hot key is only refined further; no window is left out.
    """

    size: int
    gram: int
    fine_gram: int
    hot: int = 2048


def gram_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams: differences of prefix sums of item * BASE**position, shifted back."""
    n = len(items)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((items + np.uint64(1)) * powers, out=sums[1:])
        back = np.full(n - k + 1, pow(BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mixed((sums[k:] - sums[:-k]) * back)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def find_runs(items: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, text number, first window, number of windows and number of anchors of each run.

    ``items`` holds texts of the given ``lengths`` one after the other. A run with two or more
    anchors (places of its smallest gram) may repeat inside itself.
    """
    grams = gram_hashes(items, gram)
    w = size - gram + 1
    smallest = sliding_min(grams, w)
    offsets, windows = ragged_starts(lengths)[:-1], np.maximum(lengths - size + 1, 0)
    starts = ragged_ranges(offsets, windows)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    keys, owner = smallest[starts], np.repeat(np.arange(len(lengths)), windows)
    place = np.arange(len(starts)) - np.repeat(ragged_starts(windows)[:-1], windows)
    new = np.ones(len(starts), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    # anchors: grams equal to the key anywhere in the run's windows
    reach = count + w - 1
    equal = grams[ragged_ranges(starts[at], reach)] == np.repeat(keys[at], reach)
    anchors = np.add.reduceat(equal.astype(np.int64), ragged_starts(reach)[:-1])
    return keys[at], owner[at], place[at], count, anchors


Items = Callable[[bytes], np.ndarray]


def _runs(rows: DataFrame, items: Callable[[], Items], windows: Windows) -> DataFrame:
    """``key, row_key, start, n, anchors`` of every run of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = items()
        for part in slices(batches, 1, 1 << 20):
            texts = [of(t or b"") for t in part.column(1).to_pylist()]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            key, owner, start, n, anchors = find_runs(np.concatenate(texts).astype(np.uint64), lengths, windows.size, windows.gram)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(pa.array(owner)),
                                              pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                                              pa.array(np.minimum(anchors, 2).astype(np.int32))], ["key", "row_key", "start", "n", "anchors"])

    return rows.mapInArrow(run, "key long, row_key binary, start int, n int, anchors int")


def _segments(rows: DataFrame, items: Callable[[], Items], windows: Windows) -> DataFrame:
    """``key, id, segment, row_key, start, n, anchors``: the items of each run, hot ones cut finer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = items()
        for part in slices(batches, 1, 4 << 20):
            out: list[list] = [[] for _ in range(7)]

            def add(key: int, seq: np.ndarray, i: int, start: int, n: int, anchors: int) -> None:
                for a in range(0, n, LONGEST):
                    m = min(LONGEST, n - a)
                    body = seq[start + a:start + a + m + windows.size - 1].tobytes()
                    for column, value in zip(out, (key, xxhash.xxh3_128_digest(body), body, i, start + a, m, anchors)):
                        column.append(value)

            for i, (text, runs) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                seq = of(text)
                for r in runs:
                    if not r["hot"]:
                        add(r["key"], seq, i, r["start"], r["n"], r["anchors"])
                        continue
                    own = seq[r["start"]:r["start"] + r["n"] + windows.size - 1].astype(np.uint64)
                    fine, _, first, count, anchors = find_runs(own, np.array([len(own)]), windows.size, windows.fine_gram)
                    joint = mixed(fine + np.uint64(r["key"] % (1 << 64))).view(np.int64)
                    for key, a, n, k in zip(joint.tolist(), first.tolist(), count.tolist(), anchors.tolist()):
                        add(key, seq, i, r["start"] + a, n, min(k, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()),
                 part.column(0).take(pa.array(out[3], pa.int32())), pa.array(out[4], pa.int32()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.int32())],
                ["key", "id", "segment", "row_key", "start", "n", "anchors"])

    return rows.mapInArrow(run, "key long, id binary, segment binary, row_key binary, start int, n int, anchors int")


def _folded(segments: DataFrame) -> DataFrame:
    """Equal segments of a key as one, with their number of places."""
    return segments.groupBy("key", "id", "segment", "n").agg(F.count(F.lit(1)).alias("times"), F.max("anchors").alias("anchors"))


def _marks_by_window(folded: DataFrame, items: Callable[[], Items], windows: Windows) -> DataFrame:
    """The marks of keys too large for one task, by counting their windows one by one.

    Only digests move. A window in very many segments is one row per task when counted, and
    one row of the other side when its places are joined, which adaptive execution splits.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = items()(b"").dtype.itemsize
        for part in slices(batches, 2, 1 << 18):
            at, owner, digests = [], [], []
            for i, (body, n) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                at += range(n)
                owner += [i] * n
                digests += [hashlib.blake2b(body[a * width:(a + windows.size) * width], digest_size=16).digest() for a in range(n)]
            rows = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), part.column(0).take(rows), part.column(1).take(rows), pa.array(at, pa.int32()),
                                              part.column(3).take(rows), part.column(4).take(rows)], ["digest", "key", "id", "at", "n", "times"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            marks = []
            for n, at in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                bits = np.zeros(n, bool)
                bits[at] = True
                marks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(marks, pa.binary())], ["key", "id", "marks"])

    single = folded.select("key", "id", "segment", "n", "times").mapInArrow(cut, "digest binary, key long, id binary, at int, n int, times long")
    twice = single.groupBy("digest").agg(F.sum("times").alias("places")).where("places > 1").select("digest")
    found = single.join(twice, "digest").groupBy("key", "id", "n").agg(F.collect_list("at").alias("at"))
    return found.mapInArrow(packed, "key long, id binary, marks binary")


#: Segments of a shard, their counts and numbers of windows -> for each, which windows occur twice.
Index = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


def _marks(segments: DataFrame, index: Index, shard_bytes: int) -> DataFrame:
    """``key, id, marks``: a bit for each window of a segment, set where the window occurs twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(shard: list[tuple]) -> pa.RecordBatch:
            found = index([x[2] for x in shard], np.array([x[4] for x in shard]), np.array([x[3] for x in shard]))
            some = [(x[0], x[1], np.packbits(m).tobytes()) for x, m in zip(shard, found) if m.any()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], t) for k, t in ((0, pa.int64()), (1, pa.binary()), (2, pa.binary()))],
                                              ["key", "id", "marks"])

        def several(group: list[tuple]) -> bool:
            """Whether a key has two segments, one of two places, or one that may repeat inside."""
            return len(group) > 1 or group[0][4] > 1 or group[0][5] > 1

        shard, held, group = [], 0, []  # rows come sorted by key, so that a key's segments follow each other
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if several(group):
                        shard += group
                        held += sum(len(x[2]) for x in group)
                    group = []
                    if held >= shard_bytes:
                        yield solved(shard)
                        shard, held = [], 0
                group.append(row)
        if group and several(group):
            shard += group
        if shard:
            yield solved(shard)

    ordered = _folded(segments).repartition("key").sortWithinPartitions("key")
    return ordered.select("key", "id", "segment", "n", "times", "anchors").mapInArrow(run, "key long, id binary, marks binary")


def touched(docs: DataFrame, items: Callable[[], Items], index: Index, windows: Windows, doc_id: str = "doc_id", text: str = "text",
            shard_bytes: int = 4 << 20) -> DataFrame:
    """``row_key, text, spans``: the texts (bytes) in which windows occur twice, and the places.

    ``spans`` holds structs of first window, number of windows and packed marks. ``items()``
    gives, in a worker, the function from a text to its items.
    """
    rows = docs.select(row_key(doc_id, text).alias("row_key"), F.col(text).cast("string").cast("binary").alias("text"))
    spark, early, paths = docs.sparkSession, [], []
    runs = stored(_runs(rows, items, windows), "runs", early)
    counted = runs.groupBy("key").agg(F.sum("anchors").alias("times"), F.count(F.lit(1)).alias("runs")).where("times > 1")
    known = counted.select("key", (F.col("runs") > windows.hot).alias("hot"))
    again = runs.join(known, "key").groupBy("row_key").agg(F.collect_set(F.struct("key", "start", "n", "anchors", "hot")).alias("runs"))
    parts = stored(rows.join(again, "row_key").select("row_key", "text", "runs"), "candidates", paths)
    release(spark, early)
    segments = stored(_segments(parts, items, windows), "segments", paths)
    many = segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > windows.hot).select("key")
    distinct = segments.select("key", "id").join(many, "key", "left_semi").distinct()
    still = stored(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > windows.hot).select("key"), "still-hot", paths)
    if still.isEmpty():
        marks = _marks(segments, index, shard_bytes)
    else:
        hot = stored(_folded(segments.join(still, "key", "left_semi")), "hot", paths)
        marks = _marks(segments.join(still, "key", "left_anti"), index, shard_bytes).unionByName(_marks_by_window(hot, items, windows))
    places = segments.select("key", "id", "row_key", "start", "n").join(marks, ["key", "id"])
    spans = places.groupBy("row_key").agg(F.collect_set(F.struct("start", "n", "marks")).alias("spans"))
    found = stored(parts.select("row_key", "text").dropDuplicates(["row_key"]).join(spans, "row_key"), "touched")
    release(spark, paths)
    return found


def covered(length: int, spans: list[dict], size: int) -> np.ndarray:
    """Which of ``length`` items lie in a marked window."""
    edge = np.zeros(length + 1, np.int64)
    for span in spans:
        at = span["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(span["marks"], np.uint8), count=span["n"]))
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0
