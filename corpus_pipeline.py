"""A corpus pipeline over ``documents``: filter, two kinds of repeated passages, near
duplicates, and packing into batches. ``STAGES`` lists its stages in order.

Defined cases: an empty table stays empty. Null and empty texts fail the quality rules and go
there. A document that line dedup leaves without a word goes, as all it held stays elsewhere.
Rows equal in id and text are treated alike by the first stages, and one of them stays as a
near duplicate. Null ids and further columns, whatever their names, pass through to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom.llm import jaccard, lines, packing, quality, suffixes
from fareloom.llm.common import NOT_SPACE, read_table, release, stored


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date with the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of two or more lines stay at their first place only; a document that
    loses all its words that way goes."""
    found = lines.remove_blocks(docs)
    return _counted(lines.rewritten(docs, found.where((F.col("n_removed") == 0) | F.col("new_text").rlike(NOT_SPACE))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of ``PASSAGE`` bytes that occur at two places go at all of them."""
    return _counted(suffixes.remove(docs, size=PASSAGE))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences with their length bucket, batch and slot."""
    return packing.pack(docs)


#: Bytes of a repeated passage: fewer than 51 words take here, as words have 6.3 bytes with their blank on average.
PASSAGE = 200

STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("suffix_dedup", suffix_dedup), ("packing", packed)]

#: SQL can't express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the scratch folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        done: list[str] = []
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", done)
        release(spark, before)  # the stage before last is read no more
        before = done
    return STAGES[-1][1](spark, docs, sf_dir)
