"""Side tables of a store, which spare a batch the reading of the whole store.

Beside a store at ``path``, ``path.ledger`` holds two tables of signed changes, each merge a
folder of its own: ``ids`` (which month holds a quote id, in hash buckets) and ``fares`` (how
often a fare occurs in a cohort, in shards of cohorts). What holds is the sum of the changes,
so a batch appends its own and reads the buckets and shards it touches. When the changes
are as many as what they began with, they are folded into a new generation, so that each
row is rewritten a bounded number of times on average.

A merge first writes its rows and changes where nobody looks, then notes in the journal that
it is ready, replaces the months, and notes that it is done. One that was interrupted before
it was ready has left no trace; one after that is finished by the next merge, as all of its
steps can be repeated. Writers of one store must follow one another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

BUCKETS, SHARDS = 16, 16
LEAST_FOLD = 1_000_000  # changes are folded when they are as many as what they began with, and so many
MOST_FOLDERS = 256  # or after so many merges
COHORT = ["sector", "advance_days", "weekday"]
IDS = "quote_id string, travel_month string, n long, merge int, bucket int"
FARES = "sector string, advance_days int, weekday int, fare double, n long, merge int, shard int"
JOURNAL = "merge int, step int, generation int, folders int, base_rows long, change_rows long, months array<string>"
READY, DONE, STALE = 1, 2, 3


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there are files of a table at ``path``."""
    try:
        return bool(spark.read.schema("quote_id string").parquet(path).inputFiles())
    except AnalysisException:  # no such folder yet
        return False


def bucket(key: str = "quote_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def shard() -> Column:
    return F.pmod(F.xxhash64("sector", F.col("advance_days").cast("int"), F.col("weekday").cast("int")), F.lit(SHARDS)).cast("int")


def fare_rows(facts: DataFrame, fare: str = "total_fare") -> DataFrame:
    """``COHORT, fare, n``: a row with a count of one for each fare, not folded."""
    rows = facts.select("sector", F.col("advance_days").cast("int").alias("advance_days"), F.weekday("travel_date").cast("int").alias("weekday"),
                        F.col(fare).cast("double").alias("fare"), F.lit(1).cast("long").alias("n"))
    return rows.filter("fare is not null")


def cohort_fares(facts: DataFrame, fare: str = "total_fare") -> DataFrame:
    """``COHORT, fare, n``: equal fares of a cohort folded."""
    return fare_rows(facts, fare).groupBy(*COHORT, "fare").agg(F.sum("n").alias("n"))


def id_rows(facts: DataFrame, month: Column) -> DataFrame:
    """``quote_id, travel_month, n``: a row with a count of one for each fact, not folded."""
    return facts.select("quote_id", month.alias("travel_month"), F.lit(1).cast("long").alias("n"))


def summed(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Signed counts added up; what comes to nothing goes."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def negative(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n", -F.col("n"))


def present(column: Column, values: DataFrame) -> Column:
    """A filter that prunes folders; ``values`` is one column of few distinct values by construction."""
    return column.isin([r[0] for r in values.distinct().collect()])


class Ledger:
    """The side tables of the store at ``path``, as of its last finished merge."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, f"{path}.ledger"
        self.last: Row | None = self._last()

    def _last(self) -> Row | None:
        if not exists(self.spark, f"{self.root}/journal"):
            return None
        rows = self.spark.read.schema(JOURNAL).parquet(f"{self.root}/journal")
        return rows.orderBy(F.desc("merge"), F.desc("generation"), F.desc("step")).first()

    def _note(self, **changed) -> None:
        start = Row(merge=0, step=DONE, generation=0, folders=0, base_rows=0, change_rows=0, months=[])
        entry = (self.last or start).asDict() | changed
        self.spark.createDataFrame([tuple(entry.values())], JOURNAL).coalesce(1).write.mode("append").parquet(f"{self.root}/journal")
        self.last = Row(**entry)

    @property
    def known(self) -> bool:
        """Whether the side tables follow the store."""
        return self.last is not None and self.last.step != STALE

    def staged(self) -> str:
        return f"{self.root}/staged/merge={self.last.merge if self.last else 0}"

    def _changes(self, name: str) -> DataFrame:
        schema, path = IDS if name == "ids" else FARES, f"{self.root}/{name}/generation={self.last.generation}"
        if not exists(self.spark, path):  # a new store
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).filter(F.col("merge") <= self.last.merge)

    def _write(self, name: str, changes: DataFrame, generation: int, merge: int) -> None:
        folder = "bucket" if name == "ids" else "shard"
        rows = changes.withColumn(folder, bucket() if name == "ids" else shard())
        # each task writes to the folders as the fold before has dealt the rows, so they are shuffled once
        rows.write.mode("overwrite").partitionBy(folder).parquet(f"{self.root}/{name}/generation={generation}/merge={merge}", compression="zstd")

    def months_of(self, ids: DataFrame) -> DataFrame:
        """``quote_id, travel_month`` of those of ``ids`` that the store holds; their buckets are read only."""
        if not exists(self.spark, f"{self.root}/ids/generation={self.last.generation}"):  # a new store: nothing to look ids up in
            return self.spark.createDataFrame([], "quote_id string, travel_month string")
        wanted = ids.select("quote_id")
        held = self._changes("ids").filter(present(F.col("bucket"), wanted.select(bucket())))
        held = held.join(wanted, "quote_id", "left_semi")
        return summed([held.select("quote_id", "travel_month", "n")], ["quote_id", "travel_month"]).drop("n")

    def fares_of(self, cohorts: DataFrame) -> DataFrame:
        """``COHORT, fare, n`` of the given cohorts; their shards are read only."""
        wanted = cohorts.select("sector", F.col("advance_days").cast("int").alias("advance_days"), F.col("weekday").cast("int").alias("weekday")).distinct()
        held = self._changes("fares").filter(present(F.col("shard"), wanted.select(shard())))
        return summed([held.join(wanted, COHORT, "left_semi").select(*COHORT, "fare", "n")], [*COHORT, "fare"])

    def adopt(self, facts: DataFrame | None, month: str = "travel_month") -> None:
        """Side tables for the rows of a store that has none, or outdated ones: one pass, once."""
        generation, merge = (self.last.generation + 1, self.last.merge + 1) if self.last else (0, 0)
        if facts is None:
            return self._note(merge=merge, step=DONE, generation=generation, folders=0, base_rows=0, change_rows=0, months=[])
        self._write("ids", summed([id_rows(facts, F.col(month))], ["quote_id", "travel_month"]), generation, merge)
        self._write("fares", cohort_fares(facts), generation, merge)
        rows = self.spark.read.schema(IDS).parquet(f"{self.root}/ids/generation={generation}").count()
        self._note(merge=merge, step=DONE, generation=generation, folders=1, base_rows=rows, change_rows=0, months=[])

    def outdated(self) -> None:
        """Notes that the store was written past the ledger, if it has one."""
        if self.last is not None:
            self._note(step=STALE)

    def commit(self, before: DataFrame, after: DataFrame, months: list[str], replace: Callable[[DataFrame, list[str]], None]) -> None:
        """Puts ``after`` in the place of ``before``, which are all rows of ``months``."""
        merge, month = self.last.merge + 1, F.date_format("travel_date", "yyyy-MM")
        staged = f"{self.root}/staged/merge={merge}"
        after.write.mode("overwrite").parquet(staged, compression="zstd")
        after = self.spark.read.schema(after.schema).parquet(staged)
        # both sides are folded together, in one shuffle
        self._write("ids", summed([id_rows(after, month), negative(id_rows(before, month))], ["quote_id", "travel_month"]), self.last.generation, merge)
        self._write("fares", summed([fare_rows(after), negative(fare_rows(before))], [*COHORT, "fare"]), self.last.generation, merge)
        rows = self.spark.read.schema("n long").parquet(f"{self.root}/ids/generation={self.last.generation}/merge={merge}").count()
        # the first changes of a generation are what it begins with: there is nothing to fold them into
        base, changes = (self.last.base_rows, self.last.change_rows + rows) if self.last.folders else (rows, 0)
        self._note(merge=merge, step=READY, folders=self.last.folders + 1, base_rows=base, change_rows=changes, months=months)
        self.finish(replace, after)

    def finish(self, replace: Callable[[DataFrame, list[str]], None], like: DataFrame) -> None:
        """Carries out a merge that is ready, also one that was interrupted."""
        if self.last is None or self.last.step != READY:
            return
        staged = self.staged()
        replace(self.spark.read.schema(like.schema).parquet(staged), list(self.last.months))
        self._note(step=DONE)
        self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(staged)
        if self.last.change_rows >= max(self.last.base_rows, LEAST_FOLD) or self.last.folders >= MOST_FOLDERS:
            self._fold()

    def _fold(self) -> None:
        old, generation = self.last.generation, self.last.generation + 1
        for name, keys in (("ids", ["quote_id", "travel_month"]), ("fares", [*COHORT, "fare"])):
            self._write(name, summed([self._changes(name).select(*keys, "n")], keys), generation, self.last.merge)
        rows = self.spark.read.schema("n long").parquet(f"{self.root}/ids/generation={generation}").count()
        self._note(step=DONE, generation=generation, folders=1, base_rows=rows, change_rows=0)
        for name in ("ids", "fares"):
            self.spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(f"{self.root}/{name}/generation={old}")
