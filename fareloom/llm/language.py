"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text (no sample), hashed into a fixed number
of buckets and summed by (language, bucket). The matrix of log probabilities has one row
per bucket and one column per language; it is broadcast, and its size is checked against a
stated bound. Scoring works on batches in numpy: the n-grams of a batch form the rows of a
sparse document-by-bucket matrix, which is multiplied by the dense one.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a null
language is not learned from; without labelled texts all is ``und``; the first language in
alphabetical order wins a tie; equal rows get equal results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import mixed, slices

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """n-gram lengths, log2 of the buckets, additive smoothing, and the most languages (this
    bounds the broadcast matrix: 2**bits * max_languages * 4 bytes, 64 MB by default)."""

    lengths: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    smoothing: float = 0.5
    max_languages: int = 256


def _grams(texts: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as a sparse matrix: (column) buckets and (row) text numbers.

    Each text is lower-cased and stands between blanks; n-grams never cross texts.
    """
    lowered = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    parts, owners, value = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(settings.lengths) + 1):
        # the value of an n-gram: that of its first n - 1 characters, extended by the last
        value = points if n == 1 else value[:-1] * np.uint64(0x1000193F) + points[n - 1:]
        if n in settings.lengths:
            inside = owner[:len(value)] == owner[n - 1:]
            parts.append((mixed(value[inside] + np.uint64(n << 56)) >> np.uint64(64 - settings.bits)).astype(np.int32))
            owners.append(owner[:len(value)][inside])
    return np.concatenate(parts), np.concatenate(owners)


def train(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, bucket, n``: n-gram counts over all labelled texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, 1, 2 << 20):
            langs, texts = part.column(0).to_pylist(), part.column(1).cast(pa.string()).to_pylist()
            for name in dict.fromkeys(langs):
                grams, _ = _grams([t for t, x in zip(texts, langs) if x == name], settings)
                counts = np.bincount(grams, minlength=1 << settings.bits)
                total[name] = total[name] + counts if name in total else counts
            if len(total) > settings.max_languages:
                raise ValueError(f"more than {settings.max_languages} languages")
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(lang).cast("string"), F.col(text).cast("string").cast("binary")).toDF("lang", "text").dropna()
    counted = rows.mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def matrix(counts: DataFrame, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities by bucket and language.

    The counts have at most 2**bits rows for each of at most ``max_languages`` languages.
    """
    langs = sorted(r.lang for r in counts.select("lang").distinct().limit(settings.max_languages + 1).collect())
    if len(langs) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    table = counts.toArrow()
    column = pc.index_in(table["lang"], pa.array(langs, pa.string())).to_numpy()
    dense = np.full((1 << settings.bits, len(langs)), settings.smoothing)
    dense[table["bucket"].to_numpy(), column] += table["n"].to_numpy()
    return langs, (np.log(dense) - np.log(dense.sum(axis=0))).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray, settings: Settings = Settings(),
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the likeliest language and its posterior probability.

    All languages have the same prior.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(weights.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        for part in slices(batches, 1, 1 << 20):
            texts = part.column(1).cast(pa.string()).to_pylist()
            found, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if names else []
            if known:
                grams, rows = _grams([texts[i] for i in known], settings)
                # sparse times dense: each entry of a row adds its bucket's log probability
                sums = np.stack([np.bincount(rows, logs[k][grams], len(known)) for k in range(len(names))], axis=1)
                best = sums.argmax(axis=1)
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                found[known] = np.array(names, object)[best]
                score[known] = 1.0 / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training leaves out."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2
