"""Official consumer-price records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import double_of
from fareloom.sources.schemas import CPI_FILE


def normalize_cpi(df: DataFrame) -> DataFrame:
    """Text to numbers, defaults for missing fields, ``class`` -> ``item_class``."""
    present = set(df.columns)

    def field(name: str):
        value = F.col(f"`{name}`").cast("string") if name in present else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(C.CPI_DEFAULTS[name])) if name in C.CPI_DEFAULTS else value

    names = [f.name for f in CPI_FILE.fields if f.name not in ("index", "inflation")]
    return df.select(
        *[field(n).alias("item_class" if n == "class" else n) for n in names],
        F.coalesce(double_of(field("index")), F.lit(100.0)).alias("index_value"),
        double_of(field("inflation")).alias("inflation_pct"))


def read_cpi_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """S7."""
    return normalize_cpi(spark.read.schema(CPI_FILE).option("multiLine", multi_line).json(path))


def cpi_select(df: DataFrame, kind: str) -> DataFrame:
    """``airfare``, ``transport`` or ``general`` records."""
    if kind == "airfare":
        return df.filter(F.col("code") == C.CPI_AIRFARE_CODE)
    if kind == "transport":
        return df.filter((F.col("code") == C.CPI_TRANSPORT_CODE)
                         | F.coalesce(F.contains(F.col("division"), F.lit("Transport")), F.lit(False)))
    if kind == "general":
        return df.filter(F.col("division") == "CPI (General)")
    raise ValueError(f"unknown kind: {kind}")


def append_cpi(records: DataFrame, path: str, load_no: int) -> None:
    """Append a load; ``record_id`` grows with the load and within it."""
    numbered = records.withColumn(
        "record_id", F.lit(load_no).cast("bigint") * F.lit(1 << 40) + F.monotonically_increasing_id())
    numbered.write.mode("append").parquet(path)


def latest_cpi(records: DataFrame, keys: tuple[str, ...] = ("base_year", "code")) -> DataFrame:
    """National record with the highest id per key (one row per key leaves each map task)."""
    national = records.filter((F.col("state") == "All India") & (F.col("sector") == "Combined"))
    newest = Window.partitionBy(*keys).orderBy(F.desc("record_id"))
    return national.withColumn("place", F.row_number().over(newest)).filter("place = 1").drop("place")


def cpi_benchmarks(records: DataFrame, base_year: str = "2024") -> DataFrame:
    """Latest airfare and transport record of a base year, with default values."""
    wanted = {"airfare": (C.CPI_AIRFARE_CODE, *C.CPI_AIRFARE_DEFAULT),
              "transport": (C.CPI_TRANSPORT_CODE, *C.CPI_TRANSPORT_DEFAULT)}
    national = records.filter((F.col("state") == "All India") & (F.col("sector") == "Combined")
                              & (F.col("base_year") == base_year))
    row = F.struct("index_value", "inflation_pct", "month", "year")
    newest = national.agg(*[
        F.max_by(row, F.when(F.col("code") == code, F.col("record_id"))).alias(kind)
        for kind, (code, *_) in wanted.items()])
    found = newest.select(F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.col(kind).alias("r"),
                 F.lit(index).alias("d_index"), F.lit(inflation).alias("d_inflation"))
        for kind, (code, index, inflation) in wanted.items()])).alias("b")).select("b.*")
    missing = F.col("r").isNull()
    return found.select(
        F.lit(base_year).alias("base_year"), "kind", "code",
        F.coalesce("r.index_value", "d_index").alias("index_value"),
        F.when(missing, F.col("d_inflation")).otherwise(F.col("r.inflation_pct")).alias("inflation_pct"),
        F.coalesce("r.month", F.lit(C.CPI_DEFAULTS["month"])).alias("month"),
        F.coalesce("r.year", F.lit(C.CPI_DEFAULTS["year"])).alias("year"),
        F.lit(C.TRANSPORT_WEIGHT_PCT).alias("cpi_weight_pct"))
