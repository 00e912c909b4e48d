"""Quote files, the fact store and exports."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fareloom import constants as C
from fareloom.functions.numeric import to_places
from fareloom.operators.dedup import deduplicate_quotes, flight_columns, settled
from fareloom.operators.normalize import normalize_quotes
from fareloom.operators.quality import clean_rows, stored_form
from fareloom.session import stored
from fareloom.sources.ledger import COHORT, Ledger, cohort_fares, exists, negative, summed
from fareloom.sources.schemas import CLEAN_QUOTE, RAW_QUOTE_FILE
from fareloom.sources.weights import attach_dims

STORE_PARTITION = "travel_month"
FILE_QUOTES = 200_000
ESCAPE = re.compile(rb"(?s)\\.")


def read_quotes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array per file (or one object per line) to normalised quotes."""
    if not multi_line:
        return normalize_quotes(spark.read.schema(RAW_QUOTE_FILE).json(path))
    return normalize_quotes(json_objects(spark, path).select(F.from_json("value", RAW_QUOTE_FILE).alias("q")).select("q.*"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the outermost objects of JSON files, each an array, an object or objects in a row.

    Files are read in byte ranges and cut at every closing brace. Whether a brace is part of
    a string, and how deep it lies, follows from the quotes and opening braces before it. A
    range is walked in order where it is read, so texts are neither shuffled nor written: a
    file of one range begins outside strings; the ranges of a larger file are walked for
    their sums in both cases first, of which sums over a file's few ranges choose one. So one
    large array is read by many tasks. Only what objects leave over at the ends of ranges
    meets, by file. An escape never spans a cut, as no JSON escape ends in a brace. An object
    that is not closed is left out.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("split"))
    columns, parted = ["value", "file", "range"], pieces.filter("split")
    sums = parted.select(*columns).mapInArrow(range_sums, "file string, range long, quotes long, step_0 long, step_1 long")
    starts = range_starts(sums)
    known = {(r["file"], r["range"]): (r["in_string"], r["depth"]) for r in starts.collect()}  # a row for each range of a large file
    whole = pieces.select(*columns).mapInArrow(lambda batches: range_objects(batches, known, True), RANGE_TEXT).select("value")
    if known:
        ends = stored(parted.select(*columns).mapInArrow(lambda batches: range_objects(batches, known, False), RANGE_TEXT), "range-ends")
        before = Window.partitionBy("file").orderBy("range", "place").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("number", F.coalesce(F.sum(F.col("ended").cast("int")).over(before), F.lit(0)))
        joined = ends.groupBy("file", "number").agg(
            F.sort_array(F.collect_list(F.struct("range", "place", "value"))).alias("parts"), F.max("ended").alias("ended"))
        spanning = joined.filter("ended").select(F.array_join(F.transform("parts", lambda p: p["value"].cast("string")), "").cast("binary").alias("value"))
        whole = whole.unionByName(spanning)
    return whole.select(F.regexp_replace(F.col("value").cast("string"), r"^[^{]*", "").alias("value"))


RANGE_TEXT = "file string, range long, place long, ended boolean, value binary"


def range_starts(sums: DataFrame) -> DataFrame:
    """``file, range, in_string, depth`` at the start of each range, from the sums over the ranges."""
    ranges = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("in_string", F.coalesce(F.sum("quotes").over(ranges), F.lit(0)) % 2)
    sums = sums.withColumn("step", F.when(F.col("in_string") == 0, F.col("step_0")).otherwise(F.col("step_1")))
    return sums.select("file", "range", "in_string", F.coalesce(F.sum("step").over(ranges), F.lit(0)).alias("depth"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """Runs of pieces of one range, in order; a long range comes in several runs, one after the other."""
    for batch in batches:
        value, file, start = batch.columns
        if not batch.num_rows:
            continue
        other = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield (file[a].as_py(), start[a].as_py()), value[a:b].to_pylist()


def _marks(piece: bytes) -> list[bytes]:
    """A piece between its quotes; every second entry is in a string."""
    return (ESCAPE.sub(b"", piece) if b"\\" in piece else piece).split(b'"')


def range_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: its quotes, and opening less closing braces if it begins outside and inside a string."""
    at, quotes, steps = None, 0, [0, 0]
    for key, pieces in chain(_by_range(batches), [(None, [])]):
        if key != at:
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, quotes, *steps)], ["file", "range", "quotes", "step_0", "step_1"])
            at, quotes, steps = key, 0, [0, 0]
        for piece in pieces:
            marks = _marks(piece)
            for first in (0, 1):
                inside = (quotes + first) % 2
                steps[first] += b"".join(marks[inside::2]).count(b"{") - ((inside + len(marks) - 1) % 2 == 0)
            quotes += len(marks) - 1


def range_objects(batches: Iterator[pa.RecordBatch], known: dict[tuple[str, int], tuple[int, int]], whole: bool) -> Iterator[pa.RecordBatch]:
    """The objects that lie in one range; or the rest: what a range's first object has left, and what its last one leaves.

    ``known``: (in a string, depth) at the start of the ranges of large files.
    """
    at, place = None, 0
    for key, pieces in chain(_by_range(batches), [(None, [])]):
        out: list[tuple] = []
        if key != at:
            if at is not None and at in known and held and not whole:
                out.append((*at, place, False, b"}".join(held) + b"}"))
            at, held, place = key, [], 0
            inside, depth = known.get(key, (0, 0))
            first = key is not None and key[1] > 0  # what comes before the first end belongs to the range before
        for piece in pieces:
            marks = _marks(piece)
            opened = b"".join(marks[inside::2]).count(b"{")
            inside = (inside + len(marks) - 1) % 2
            depth += opened - (not inside)
            held.append(piece)
            if not inside and depth == 0:
                if first != whole:
                    out.append((*at, place, True, b"}".join(held) + b"}"))
                place, held, first = place + 1, [], False
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                ["file", "range", "place", "ended", "value"])


def quote_json(df: DataFrame) -> DataFrame:
    """S2, the text form: one JSON object per row, amounts, dates and times as strings."""
    shown = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if k == "timestamp"
             else F.col(c).cast("string").alias(c) if k.startswith("decimal") or k == "date" else F.col(c)
             for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*shown)).alias("value"))


def write_quotes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compressed text; a file has so few quotes that one task reads it, as it can't be split."""
    quote_json(df).write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", FILE_QUOTES).text(path)


def to_facts(raw: DataFrame) -> DataFrame:
    """Clean raw quotes row by row and give them the stored form with dimension keys."""
    return stored_form(attach_dims(clean_rows(raw)))


def upsert_quotes(existing: DataFrame, batch: DataFrame, key: str = "quote_id",
                  order: tuple[str, ...] = ("scrape_timestamp",), count_first: bool = False) -> DataFrame:
    """Stored ∪ batch, one row per key; the batch wins, then the newest.

    Repeats are cut to one row per key in each map task before the shuffle. With
    ``count_first`` keys are counted before, and only rows of repeated ones are shuffled.
    """
    both = existing.withColumn("batch_no", F.lit(0)).unionByName(batch.withColumn("batch_no", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.desc("batch_no"), *[F.desc(c) for c in order])
    first = lambda rows: rows.withColumn("place", F.row_number().over(newest)).filter("place = 1").drop("place")
    return (settled(both, [key], first) if count_first else first(both)).drop("batch_no")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The fact table; filters on the travel month prune folders."""
    schema = StructType([*CLEAN_QUOTE.fields, StructField(STORE_PARTITION, StringType())])
    return spark.read.schema(schema).parquet(path)


def write_store(facts: DataFrame, path: str) -> None:
    """Month folders, sorted within for the index's filters; touched months are replaced.

    The side tables of a store that is kept by :func:`merge_store` are built anew at the
    next merge.
    """
    _write_months(facts, path)
    Ledger(facts.sparkSession, path).outdated()


def _write_months(facts: DataFrame, path: str) -> None:
    """Rebalancing keeps a month and sector together only as far as the advisory partition
    size goes; a cell with very many rows becomes several tasks and files."""
    monthly = facts.withColumn(STORE_PARTITION, F.date_format("travel_date", "yyyy-MM"))
    (monthly.hint("rebalance", STORE_PARTITION, "sector").sortWithinPartitions("sector", "advance_days", "carrier_code")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(STORE_PARTITION).parquet(path))


def one_per_flight(facts: DataFrame, count_first: bool = False) -> DataFrame:
    """W2 on stored facts; a fare put in for a sold-out quote counts as the missing one it was."""
    filled = F.col("is_sold_out") & (F.col("total_fare") == C.SOLD_OUT_FARE)
    first = lambda rows: deduplicate_quotes(rows, F.when(filled, 0.0).otherwise(F.col("total_fare")))
    return settled(facts, flight_columns(), first) if count_first else first(facts)


def _replace_months(path: str) -> Callable[[DataFrame, list[str]], None]:
    def replace(whole: DataFrame, months: list[str]) -> None:
        _write_months(whole, path)
        left = {r[0] for r in whole.select(F.date_format("travel_date", "yyyy-MM")).distinct().collect()}
        for month in months:  # months that lost all their rows, which replacing folders leaves as they were
            if month not in left and exists(whole.sparkSession, f"{path}/{STORE_PARTITION}={month}"):
                whole.limit(0).write.mode("overwrite").parquet(f"{path}/{STORE_PARTITION}={month}")
    return replace


def open_store(spark: SparkSession, path: str) -> Ledger:
    """The store's side tables, an interrupted merge finished, and made if there are none."""
    ledger = Ledger(spark, path)
    empty = spark.createDataFrame([], CLEAN_QUOTE)
    ledger.finish(_replace_months(path), empty)
    if not ledger.known:
        ledger.adopt(read_store(spark, path) if exists(spark, path) else None)
    return ledger


def merge_store(spark: SparkSession, path: str, batch: DataFrame, per_flight: bool = False, cheap: bool = False) -> None:
    """S10 on disk: only months the batch touches are read and rewritten.

    A month also counts as touched when it holds a row the batch replaces; the id index tells
    which, from the buckets of the batch's ids. With ``per_flight`` the merged rows are
    reduced to one per flight (W2), as the quotes of a flight may come in several batches. A
    store that does not exist yet is made. A merge that fails is finished by the next one or
    has left no trace (:mod:`fareloom.sources.ledger`). A batch is written to the scratch
    folder first, unless it is ``cheap`` to compute several times, and always alike, from files.
    """
    ledger = open_store(spark, path)
    batch = batch.select(*CLEAN_QUOTE.fieldNames())
    batch = batch if cheap else stored(batch, "batch")  # used several times below
    month = F.date_format("travel_date", "yyyy-MM").alias(STORE_PARTITION)
    touched = batch.select(month).union(ledger.months_of(batch).select(STORE_PARTITION))
    months = sorted(r[0] for r in touched.distinct().collect() if r[0])  # as many as there are months at most
    kept = store_months(spark, path, months).drop(STORE_PARTITION)
    merged = upsert_quotes(kept, batch.select(*kept.columns), count_first=True)
    ledger.commit(kept, one_per_flight(merged, count_first=True) if per_flight else merged, months, _replace_months(path))


def store_months(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """The rows of some months; no other folder is read."""
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([*CLEAN_QUOTE.fields, StructField(STORE_PARTITION, StringType())]))
    return read_store(spark, path).filter(F.col(STORE_PARTITION).isin(months))


def stored_fares(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``COHORT, fare, n`` of the store's fares in the cohorts of ``rows``, less the quotes that ``rows`` replaces.

    Read are the counts of the touched cohorts, and of the facts the months that hold a
    replaced quote.
    """
    ledger = open_store(spark, path)
    counts = ledger.fares_of(rows)
    replaced = stored(ledger.months_of(rows), "replaced")
    months = [r[0] for r in replaced.select(STORE_PARTITION).distinct().collect()]
    if not months:
        return counts
    gone = store_months(spark, path, months).join(replaced, ["quote_id", STORE_PARTITION], "left_semi")
    gone = cohort_fares(gone).join(rows.select(*COHORT).distinct(), COHORT, "left_semi")
    return summed([counts, negative(gone)], [*COHORT, "fare"])


def export_rows(national: DataFrame, sectors: DataFrame, frequency: str = "daily") -> DataFrame:
    """Date, route_id, index_value, frequency, tier; one NATIONAL row per date.

    ``national``: date, value; ``sectors``: date, sector, route_tier, value.
    """
    top = national.select(F.col("date").cast("string").alias("date"), F.lit("NATIONAL").alias("route_id"),
                          to_places("value", 2).alias("index_value"), F.lit(frequency).alias("frequency"),
                          F.lit("Composite").alias("tier"))
    rest = sectors.select(F.col("date").cast("string").alias("date"), F.col("sector").alias("route_id"),
                          to_places("value", 2).alias("index_value"), F.lit(frequency).alias("frequency"),
                          F.col("route_tier").alias("tier"))
    return top.unionByName(rest)


def export_csv(rows: DataFrame, path: str, single_file: bool = True) -> None:
    """A publication is a few rows per date, so one file is the default."""
    out = rows.coalesce(1) if single_file else rows
    out.write.mode("overwrite").option("header", True).csv(path)


def export_json_rows(rows: DataFrame) -> DataFrame:
    """Date, route_id, composite, frequency."""
    return rows.select("date", "route_id", F.col("index_value").alias("composite"), "frequency")


def export_json(rows: DataFrame, path: str) -> None:
    """S16."""
    export_json_rows(rows).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """S17."""
    report.write.mode("overwrite").json(path)
