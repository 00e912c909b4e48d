"""Removal of repeated blocks of lines by content-defined chunks.

A rolling hash over the hashes of the last lines with words chooses *boundary lines*, so an
inserted line moves no boundary further on; the first and last line with words of a text are
boundaries too. A chunk runs from one boundary line to the next, both included, with the blank
lines between, so it has two lines with words at least and neighbours share a line.

A chunk that occurs again, anywhere, stays at its first place in (id, position); elsewhere its
lines go, save those that belong to a chunk's first place, so each repeated chunk stays whole
once. From a later place the cut goes on line by line, both ways, as far as the next boundary line
and while the lines equal those around the first place, so a block loses its edges too. Hashes only
nominate chunks; they are grouped by their bytes, and edges compared by theirs, before any line
goes. A removed line has an equal one at an earlier place, hence one that stays.

A repeated block that holds fewer than two boundaries is not found; ``Chunking.share`` is the
part of lines that are boundaries. The rolling window of a block's first lines reaches out of the
block, so they may be a chunk at some later places only, and then stay at the first of those too.

Defined cases: null and empty texts and texts with one line stay as they are; among equal
places (rows equal in id and text) all count as the first, while different texts under one id,
or under null, are told apart by their row key; a null id comes before all others; a text that
loses all its lines becomes empty and stays; further columns, whatever their names, pass
through in ``row``. A text is cut whole in one task, in some ten times its length of memory.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import WordHashes, let, release, row_key, slices, stored


@dataclass(frozen=True)
class Chunking:
    """Lines in the rolling window, and the share of lines that are boundaries."""

    window: int = 2
    share: float = 0.875


def boundaries(hashes: np.ndarray, chunking: Chunking = Chunking()) -> np.ndarray:
    """Indices of the boundary lines among a text's lines with words, by their hashes."""
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for back in range(min(chunking.window, n)):
        factor = np.uint64(pow(0x9E3779B97F4A7C15, back + 1, 1 << 64))
        rolled[back:] += hashes[:n - back] * factor
    rolled ^= rolled >> np.uint64(29)
    chosen = rolled % np.uint64(1024) < np.uint64(round(1024 * chunking.share))
    chosen[:1] = chosen[-1:] = True
    return np.flatnonzero(chosen)


def cuts(lines: list[bytes], known: WordHashes, chunking: Chunking = Chunking()) -> list[int]:
    """The boundary lines of a text, as indices of its lines; empty where it has no chunk."""
    full = [k for k, line in enumerate(lines) if line.strip()]
    return [full[i] for i in boundaries(known.of([lines[k] for k in full]), chunking).tolist()] if len(full) > 1 else []


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


def _bodies(texts: pa.Array, chunking: Chunking, known: WordHashes) -> Iterator[tuple[int, list[bytes], list[int], list[bytes]]]:
    """For each text with chunks: its row, lines, boundaries and the bytes of its chunks."""
    for i, whole in enumerate(texts.to_pylist()):
        lines = whole.split(b"\n") if whole else []
        at = cuts(lines, known, chunking)
        if at:
            yield i, lines, at, [b"\n".join(lines[a:b + 1]) for a, b in itertools.pairwise(at)]


def chunk_hashes(docs: DataFrame, chunking: Chunking = Chunking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, hashes``: per row with chunks, their 64-bit hashes."""
    rows = _texts(docs, doc_id, text).select("key", "text")
    shape = rows.select("key", F.array(F.lit(0).cast("long")).alias("hashes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, 1):
            found = [(i, np.array([xxhash.xxh3_64_intdigest(b) for b in bodies], np.uint64).view(np.int64)) for i, _, _, bodies in _bodies(part.column(1), chunking, known)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([i for i, _ in found], pa.int32())), pa.array([h for _, h in found], pa.list_(pa.int64()))], shape.names)

    return rows.mapInArrow(run, shape)


def nominated_chunks(docs: DataFrame, wanted: DataFrame, chunking: Chunking = Chunking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, doc_id, first_line, n_lines, hash, body, head, tail``: the chunks whose hash is in
    ``wanted`` (``key, hashes``) of their row, and the lines before (nearest first) and after
    them, as far as the next boundary line."""
    rows = _texts(docs, doc_id, text).join(wanted.hint("merge"), "key").select("key", "doc_id", "text", "hashes")
    lines_type = F.array(F.col("text"))
    shape = rows.select("key", "doc_id", F.lit(0).alias("first_line"), F.lit(0).alias("n_lines"), F.lit(0).cast("long").alias("hash"), F.col("text").alias("body"),
                        lines_type.alias("head"), lines_type.alias("tail")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, 2):
            owner, first, count, hashes, bodies, heads, tails = [], [], [], [], [], [], []
            asked = part.column(3).to_pylist()
            for i, lines, at, own in _bodies(part.column(2), chunking, known):
                some = set(asked[i])
                edges = [0, *at, len(lines)]
                for k, body in enumerate(own):
                    value = int(np.uint64(xxhash.xxh3_64_intdigest(body)).view(np.int64))
                    if value in some:
                        owner.append(i)
                        first.append(at[k])
                        count.append(at[k + 1] - at[k] + 1)
                        hashes.append(value)
                        bodies.append(body)
                        heads.append(lines[edges[k]:at[k]][::-1])
                        tails.append(lines[at[k + 1] + 1:edges[k + 3] + 1])
            at_rows = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at_rows), part.column(1).take(at_rows), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(hashes, pa.int64()),
                 pa.array(bodies, pa.binary()), pa.array(heads, pa.list_(pa.binary())), pa.array(tails, pa.list_(pa.binary()))], shape.names)

    return rows.mapInArrow(run, shape)


def _common(a: Column, b: Column) -> Column:
    """How many leading items two arrays share."""
    return let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))).cast("int")


def repeated(docs: DataFrame, chunking: Chunking = Chunking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, spans, held``: per row key, the (first_line, n_lines) to remove with their edges,
    and those of the repeated chunks at their first place.

    Hashes are counted alone, folded in each task. Texts with a hash that occurs again are then
    joined to those hashes by key, and only the nominated chunks' bytes move on; grouping
    folds them in each task, so a chunk held by a third of all texts is one row per task. Its
    places are joined to one row of the other side, which adaptive execution splits.
    """
    paths: list[str] = []
    hashes = stored(chunk_hashes(docs, chunking, doc_id, text), "chunks", paths)
    single = hashes.select("key", F.explode("hashes").alias("hash"))
    again = single.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    wanted = single.join(again.hint("merge"), "hash", "left_semi").groupBy("key").agg(F.collect_set("hash").alias("hashes"))
    # written, so that the grouping below starts from unsorted parts and folds copies first
    rows = stored(nominated_chunks(docs, wanted, chunking, doc_id, text), "nominated", paths)
    place = F.struct("doc_id", "first_line", "key")
    first = rows.groupBy("hash", "body").agg(F.min(F.struct("doc_id", "first_line", "key", "head", "tail")).alias("first"), F.count(F.lit(1)).alias("n"))
    both = rows.join(first.where("n > 1").select("hash", "body", "first").hint("merge"), ["hash", "body"])
    later = ~place.eqNullSafe(F.struct("first.doc_id", "first.first_line", "first.key"))
    before, after = _common(F.col("head"), F.col("first.head")), _common(F.col("tail"), F.col("first.tail"))
    known = both.select("key", later.alias("later"), "first_line", "n_lines", before.alias("before"), after.alias("after")).select(
        "key", F.when(F.col("later"), F.struct((F.col("first_line") - F.col("before")).alias("first_line"), (F.col("n_lines") + F.col("before") + F.col("after")).alias("n_lines"))).alias("span"),
        F.when(~F.col("later"), F.struct("first_line", "n_lines")).alias("own"))
    spans = stored(known.groupBy("key").agg(F.collect_set("span").alias("spans"), F.collect_set("own").alias("held")).where(F.size("spans") > 0), "spans")
    release(docs.sparkSession, paths)
    return spans


def remove_blocks(docs: DataFrame, chunking: Chunking = Chunking(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, new_text, n_lines, n_removed``: each input row as a struct, and its text without
    the repeated blocks of lines."""
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("key"))
    body = F.col(f"row.{text}").cast("string")
    lines = F.split(body, "\n")
    numbers = lambda c: F.flatten(F.transform(c, lambda s: F.sequence(s["first_line"], s["first_line"] + s["n_lines"] - 1)))
    dropped = F.array_except(numbers("spans"), numbers("held"))
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("dropped")), lambda i: F.get(x, i)), "\n"))
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(lines))
    spans = repeated(docs, chunking, doc_id, text)
    return rows.join(spans.select("key", dropped.alias("dropped")).hint("merge"), "key", "left").select(
        "row", F.when(F.col("dropped").isNull() | (F.size("dropped") == 0), body).otherwise(kept).alias("new_text"), n_lines.alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).alias("n_removed"))


def rewritten(docs: DataFrame, result: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``result`` in the shape of ``docs``, with the new text."""
    return result.select(*[(F.col("new_text").alias(c) if c == text else F.col("row")[c].alias(c)) for c in docs.columns])
