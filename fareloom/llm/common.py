"""Helpers shared by the text operators: row keys, scratch tables, batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.session import scratch_path

#: White space that separates words: blank and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Later stages, retries and lost executors read the files instead of computing the
    plan again. The folder is the one the cluster names in ``spark.checkpoint.dir``. The
    path is added to ``paths``, for a caller who will ``release`` it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Empties stored tables that no later plan reads, so that their room is free again."""
    for path in paths:
        spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)
    paths.clear()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that tell apart rows of different id or text, nulls included.

    Rows equal in both get one key and therefore the same result.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(doc_id), F.lit("\n"), part(text)).cast("binary")))


def text_key(text: str = "text") -> Column:
    """16 bytes that tell texts apart."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` (texts as binary) holds about ``limit`` bytes at most.

    A text is never cut; one longer than ``limit`` makes a slice of its own.
    """
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        which = np.cumsum(lengths) // limit
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(which, which[start], side="right"))
            yield batch.slice(start, end - start)
            start = end


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few; the cache only saves time."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (two xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def ragged_starts(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    offsets = ragged_starts(lengths)
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
