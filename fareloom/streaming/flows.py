"""The quote flow as Structured Streaming.

No row is dropped for being late, and no state grows for ever: ids that leave the state stay
in a table beside the sink (R2), hours are put together from the parts batches give out (R3). Every sink takes a checkpoint folder, so
a query that loses executors or its driver resumes where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import to_places
from fareloom.operators import dedup, decompose, quality
from fareloom.operators.normalize import handle_sold_out, normalize_quotes, validate_quotes
from fareloom.session import scratch_path, stored
from fareloom.sources.ledger import bucket, exists, fare_rows, present
from fareloom.sources.quotes import merge_store, stored_fares, stored_form
from fareloom.sources.schemas import RAW_QUOTE_FILE
from fareloom.sources.weights import attach_dims


def read_quote_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Raw quote files (one JSON object per line) as they arrive."""
    return spark.readStream.schema(RAW_QUOTE_FILE).option("maxFilesPerTrigger", files_per_batch).json(path)


def stream_quotes(raw: DataFrame, **tariffs) -> DataFrame:
    """The stateless part of cleaning, the same functions as in batch."""
    valid, _ = validate_quotes(normalize_quotes(raw))
    return decompose.decompose_fare(handle_sold_out(valid), exact=False, **tariffs)


def stream_dedup(quotes: DataFrame, key: str = "quote_id", keep: str = "1 hour") -> DataFrame:
    """R2, the first tier: the first row of each id among those that arrive within ``keep``.

    The watermark is on the time of arrival, so nothing is ever late, and an id leaves the
    state ``keep`` after it came. Repeats that come later are told by
    :func:`run_first_sights`, to which the stream is given.
    """
    arrived = quotes.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", keep)
    return arrived.dropDuplicatesWithinWatermark([key]).drop("arrived")


def run_first_sights(stream: DataFrame, path: str, checkpoint: str, key: str = "quote_id") -> DataFrame:
    """R2, the second tier: appends rows whose id no earlier batch had; what is there, read back.

    The ids given out are kept beside the output in hash buckets, of which a batch reads
    those of its ids and to which it adds a folder. A batch that is run again does not see
    its own folder and replaces what it wrote.
    """
    seen, schema = f"{path}.seen", f"{stream.select(key).schema[key].name} {stream.select(key).schema[key].dataType.simpleString()}, batch_id int, bucket int"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch.dropDuplicates([key]), "sights")
        if exists(spark, seen):
            known = spark.read.schema(schema).parquet(seen).filter((F.col("batch_id") < batch_id) & present(F.col("bucket"), rows.select(bucket(key))))
            rows = stored(rows.join(known, key, "left_anti"), "first-sights")
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        rows.select(key, bucket(key).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{seen}/batch_id={batch_id}")

    run_batches(stream, write, checkpoint)
    return stream.sparkSession.read.schema(stream.schema.add("batch_id", "long")).parquet(path).drop("batch_id")


HOUR = ["window", "sector", "advance_days"]


def trunk_moments(quotes: DataFrame, ts: str = "scrape_timestamp", fare: str = "total_fare") -> DataFrame:
    """Hourly count, mean and squared deviations of trunk sectors at T+1 and T+7."""
    watched = quotes.filter(F.col("sector").isin(C.TRUNK_SECTORS) & F.col("advance_days").isin(1, 7))
    return watched.groupBy(F.window(ts, "1 hour"), "sector", "advance_days").agg(
        F.count(F.lit(1)).alias("quotes"), F.avg(fare).alias("mean_fare"), (F.var_pop(fare) * F.count(F.lit(1))).alias("m2"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """Moments of parts of an hour put together: quotes, mean_fare, m2."""
    hour, n = Window.partitionBy(*HOUR), F.col("quotes")
    parts = parts.withColumn("whole", F.sum(n * F.col("mean_fare")).over(hour) / F.sum(n).over(hour))
    off = F.col("mean_fare") - F.col("whole")
    return parts.groupBy(*HOUR).agg(F.sum(n).alias("quotes"), F.first("whole").alias("mean_fare"), F.sum(F.col("m2") + n * off * off).alias("m2"))


def trunk_volatility(quotes: DataFrame, ts: str = "scrape_timestamp", fare: str = "total_fare") -> DataFrame:
    """R3 over a table: quotes, mean and deviation of each hour and cohort."""
    return _volatility(trunk_moments(quotes, ts, fare))


def _volatility(moments: DataFrame) -> DataFrame:
    return moments.withColumn("std_fare", F.sqrt(F.col("m2") / F.col("quotes"))).drop("m2")


def run_trunk_volatility(stream: DataFrame, path: str, checkpoint: str, ts: str = "scrape_timestamp", fare: str = "total_fare") -> DataFrame:
    """R3 over a stream of quotes, in any order.

    A micro-batch gives out the moments of its quotes, for open and for closed hours alike,
    and reading puts an hour's parts together. There is no state at all, so none grows, and a
    quote that comes late is one more part. A batch that is run again replaces its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        trunk_moments(batch, ts, fare).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, write, checkpoint)
    parts = stream.sparkSession.read.schema(trunk_moments(stream, ts, fare).schema.add("batch_id", "long")).parquet(path).drop("batch_id")
    return _volatility(merged_moments(parts))


def run_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Process what is there in update mode; the newest row of each key.

    Each micro-batch writes a folder of its own, so a batch that is run again replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch_id", "long")).parquet(path)
    newest = F.max_by(F.struct(*stream.columns), "batch_id").alias("row")
    return rows.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).agg(newest).select("row.*")


def upsert_batches(store: str, cohort_history: bool = True, on_batch: Callable[[DataFrame, int], None] | None = None,
                   ) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: W2, cohort statistics, P17/P18, then S10.

    A micro-batch alone would judge fares against itself, so the stored fares of the same
    cohorts count too; rows stored earlier keep the verdict of their time. Those fares are
    kept as counts beside the store, of which a batch reads and adds to its own cohorts'.
    Repeats of a flight in other batches are settled against the stored rows. Replaying a
    batch gives the same store.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        valid, _ = validate_quotes(normalize_quotes(batch))
        rows = stored(quality.with_cohort(dedup.deduplicate_quotes(valid, deal_first=True)), "micro-batch", "zstd")
        counts = fare_rows(rows, "raw_total_fare")
        if cohort_history:
            counts = counts.unionByName(stored_fares(spark, store, rows))
        framed = quality.cohort_frame(rows, quality.cohort_stats_of_counts(counts, folded=False))
        facts = stored_form(attach_dims(quality.clean_rows(framed)))
        merge_store(spark, store, facts, per_flight=True, cheap=True)
        if on_batch is not None:
            on_batch(facts, batch_id)
    return run


PUBLISHED = "series_id string, period string, published_index double, window_length int, level_adjustment_factor double, kind string, batch_id int"
VALUES = ["published_index", "window_length", "level_adjustment_factor"]
LEVELS = "series_id string, period string, level double, batch_id int, bucket int"


def spliced_tail(tails: DataFrame, length: int = 13, base_value: float = 100.0) -> DataFrame:
    """Values of a series from its first new period on, by the mean splice.

    ``tails``: series_id, known (array of (period, level) in order, with the ``length`` - 1
    periods before the first new one), start (where that is) and ring (the values published
    for those before it). The relatives come from one level series, for which the GEKS vector
    of a window is its levels over the first of them. A step reads the ring only.
    """
    def step(done: Column, k: Column) -> Column:
        first = F.greatest(F.lit(0), k - (length - 1))
        levels = F.transform(F.slice(F.col("known"), first + 1, k - first + 1), lambda e: e["level"])
        n = F.size(levels)
        history = F.slice(done["ring"], F.size(done["ring"]) - n + 2, n - 1)
        gaps = F.zip_with(history, F.slice(levels, F.lit(1), n - 1), lambda p, x: F.ln(p) - F.ln(x / F.get(levels, F.lit(0))))
        factor = F.exp(F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x) / (n - 1))
        new = F.size(done["ring"]) == 0
        row = F.struct(
            F.get("known", k)["period"].alias("period"),
            F.when(new, F.lit(base_value)).otherwise(to_places(F.get(levels, n - 1) / F.get(levels, F.lit(0)) * factor, 4)).alias("published_index"),
            n.alias("window_length"), F.when(new, F.lit(1.0)).otherwise(to_places(factor, 6)).alias("level_adjustment_factor"))
        return F.get(F.transform(F.array(row), lambda r: F.struct(
            F.slice(F.concat(done["ring"], F.array(r["published_index"])), -F.least(F.size(done["ring"]) + 1, F.lit(length)), length).alias("ring"),
            F.concat(done["rows"], F.array(r)).alias("rows"))), F.lit(0))

    rows = "array<struct<period:string,published_index:double,window_length:int,level_adjustment_factor:double>>"
    start = F.struct(F.col("ring").alias("ring"), F.expr(f"cast(array() as {rows})").alias("rows"))
    steps = F.sequence(F.col("start"), F.size("known") - 1)
    return tails.select("series_id", F.inline(F.aggregate(steps, start, step, lambda done: done["rows"])))


def run_published_series(stream: DataFrame, path: str, checkpoint: str, length: int = 13, base_value: float = 100.0) -> DataFrame:
    """New periods of series are spliced (mean splice) onto what was published.

    ``stream``: series_id, period, level, in any order; what was given out so far, read back.
    A value once published stays. A period that comes late is published, and every value from
    there on that it changes is given out again as a correction: rows of ``kind`` published and
    correction, told apart by ``batch_id``; :func:`latest_published` has the series as of now.
    A period comes once; repeats are ignored. Levels are kept beside the output in buckets of
    series, of which a batch reads those of its series. No Python function runs in a task.
    """
    levels, spark = f"{path}.levels", stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = lambda schema, at: (spark.read.schema(schema).parquet(at) if exists(spark, at) else spark.createDataFrame([], schema)).filter(
            F.col("batch_id") < batch_id)
        new = batch.groupBy("series_id", "period").agg(F.min("level").alias("level")).withColumn("bucket", bucket("series_id"))
        new = stored(new, "levels")
        here = present(F.col("bucket"), new.select("bucket"))
        known = stored(earlier(LEVELS, levels).filter(here).join(new.select("series_id").distinct(), "series_id", "left_semi"), "known-levels")
        new = stored(new.join(known, ["series_id", "period"], "left_anti"), "new-levels")
        new.select("series_id", "period", "level", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{levels}/batch_id={batch_id}")
        starts = new.groupBy("series_id").agg(F.min("period").alias("first"))
        given = earlier(PUBLISHED, path).join(starts, "series_id")
        given = given.groupBy("series_id", "period", "first").agg(F.max_by(F.struct(*VALUES), "batch_id").alias("given"))
        rows = known.select("series_id", "period", "level").unionByName(new.select("series_id", "period", "level")).join(starts, "series_id")
        given = stored(given.drop("first"), "given")
        rows = rows.join(given.select("series_id", "period", F.col("given.published_index").alias("value")), ["series_id", "period"], "left")
        whole = rows.groupBy("series_id").agg(
            F.array_sort(F.collect_list(F.struct("period", "level", "value"))).alias("all"),
            F.count_if(F.col("period") < F.col("first")).cast("int").alias("before"))
        kept = F.least(F.col("before"), F.lit(length - 1))
        known_part = F.slice("all", F.col("before") - kept + 1, F.size("all") - F.col("before") + kept)
        tails = whole.select("series_id", known_part.alias("known"), kept.alias("start"),
                             F.transform(F.slice("all", F.col("before") - kept + 1, kept), lambda e: e["value"]).alias("ring"))
        out = spliced_tail(tails, length, base_value).join(given, ["series_id", "period"], "left")
        out = out.filter(~F.col("given").eqNullSafe(F.struct(*VALUES))).withColumn(
            "kind", F.when(F.col("given").isNull(), "published").otherwise("correction")).drop("given")
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run_batches(stream, write, checkpoint)
    return spark.read.schema(PUBLISHED).parquet(path)


def latest_published(rows: DataFrame) -> DataFrame:
    """The series as of now: the last value given out for each period."""
    return rows.groupBy("series_id", "period").agg(F.max_by(F.struct(*VALUES, "kind"), "batch_id").alias("row")).select("series_id", "period", "row.*")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to parquet at ``path``, and read it back."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there through a ``foreachBatch`` function."""
    query = (stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of a folder, stored as one parquet file or as a folder of them, as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a glob pattern matches either form; files below a matching folder are found too
    return reader.parquet(f"{folder}/{name}.parque[t]")


def scratch_pair(spark: SparkSession, label: str) -> tuple[str, str]:
    """(output, checkpoint) paths in the shared folder."""
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


__all__ = [
    "latest_published", "merged_moments", "read_quote_stream", "run_available", "run_batches", "run_first_sights", "run_published_series", "run_trunk_volatility", "run_updates",
    "scratch_pair", "spliced_tail", "stream_dedup", "stream_quotes", "table_stream", "trunk_moments", "trunk_volatility", "upsert_batches",
]
