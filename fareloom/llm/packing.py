"""Packing sequences into batches through optimal length buckets.

Texts longer than ``max_length`` tokens become consecutive chunks, so every length is at
most that. The global histogram of lengths (at most ``max_length + 1`` numbers) goes to a
dynamic programme that chooses the bucket boundaries with the least padding; inside each
bucket, sequences in order of (id, chunk) fill batches of ``token_budget`` padded tokens.

Defined cases: a null or empty text is one sequence of length 0 in the first bucket; equal
rows are packed each by itself; null ids come first; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.common import NOT_SPACE, stored


@dataclass(frozen=True)
class Shape:
    """The longest sequence, the number of buckets and the padded tokens of a batch."""

    max_length: int = 2048
    buckets: int = 16
    token_budget: int = 65536


def word_count(text: str = "text") -> Column:
    """Words of a text, the default measure of length."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``cost[j]`` is the least padding of the first ``j`` distinct lengths in ``b`` buckets; a
    bucket of the lengths i..j-1 pads each sequence to ``lengths[j - 1]``.
    """
    n = len(lengths)
    if n == 0:
        return []
    total, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    cost, choices = np.full(n + 1, np.inf), []
    cost[0] = 0
    for _ in range(min(buckets, n)):
        new, choice = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            tried = cost[:j] + lengths[j - 1] * (total[j] - total[:j]) - (tokens[j] - tokens[:j])
            choice[j] = int(tried.argmin())
            new[j] = tried[choice[j]]
        cost = new
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        ends.append(int(lengths[j - 1]))
        j = choice[j]
    return ends[::-1]


def pack(docs: DataFrame, shape: Shape = Shape(), doc_id: str = "doc_id", length: Column | None = None) -> DataFrame:
    """``doc_id, chunk, n_tokens, bucket_length, batch, slot``: one row per sequence.

    ``batch`` counts from 0 inside each bucket; (``bucket_length``, ``batch``) names a batch.
    """
    size = F.greatest(F.coalesce((word_count() if length is None else length).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"))
    chunks = F.greatest(F.ceil(F.col("size") / shape.max_length), F.lit(1)).cast("int")
    cut = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    rows = stored(cut.select("doc_id", "chunk", F.least(F.col("size") - F.col("chunk").cast("long") * shape.max_length,
                                                        F.lit(shape.max_length)).cast("long").alias("n_tokens")), "lengths")
    # at most max_length + 1 rows, whatever the table's size
    histogram = sorted((r.n_tokens, r.n) for r in rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    ends = boundaries(np.array([x for x, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64), shape.buckets)
    # the boundaries are a short literal list: the smallest one that holds the sequence
    bucket = F.array_min(F.filter(F.array(*map(F.lit, ends or [0])), lambda e: e >= F.col("n_tokens"))).cast("long")
    return _batches(rows.withColumn("bucket_length", bucket), shape)


def _batches(rows: DataFrame, shape: Shape) -> DataFrame:
    """Numbers the sequences of each bucket over all tasks and cuts the numbers into batches.

    A range partitioning by (bucket, id, chunk) gives every task a stretch of the order, so
    a bucket with most of the rows is spread over many tasks; a task numbers its own rows
    and adds the rows of earlier tasks in that bucket. Cut points differ between runs,
    the numbers do not.
    """
    order = ["bucket_length", "doc_id", "chunk", "n_tokens"]
    parts = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "stretches")
    counts = parts.groupBy("bucket_length", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket and task: the window holds as many rows as the plan has tasks
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("bucket_length", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("bucket_length", "part").orderBy("doc_id", "chunk", "n_tokens"))
    numbered = parts.withColumn("own", own).join(offsets, ["bucket_length", "part"])
    place = F.col("before") + F.col("own") - 1
    per_batch = F.greatest(F.floor(F.lit(shape.token_budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1)).cast("long")
    return numbered.select("doc_id", "chunk", "n_tokens", "bucket_length", F.floor(place / per_batch).cast("long").alias("batch"),
                           (place % per_batch).cast("long").alias("slot"))
