"""Weight files and dimensions.

A weight file is one JSON document, so it is read as one text value. Its objects are
keyed by code and become rows through ``from_json`` to a map and ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.text import code, window_days
from fareloom.operators.national import normalise


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``doc``: the whole JSON document."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")


def _entries(docs: DataFrame, field: str, doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, value) rows of the object ``field``; values stay JSON text."""
    inner = F.get_json_object(F.col(doc), f"$.{field}")
    return docs.select(*keep, F.explode(F.from_json(inner, "map<string,string>")).alias("key", "value"))


def _number(value: Column, field: str | None = None) -> Column:
    text = value if field is None else F.get_json_object(value, f"$.{field}")
    return text.try_cast("double")


def sector_weights_from(docs: DataFrame, doc: str = "doc", expect: int | None = 30) -> DataFrame:
    """S3 on documents already loaded; fails at run time unless ``expect`` sectors are there."""
    rows = _entries(docs, "sectors", doc).select(
        code("key").alias("sector"),
        F.coalesce(F.get_json_object("value", "$.route_tier"), F.lit("Trunk")).alias("route_tier"),
        F.coalesce(_number(F.col("value"), "distance_km"), F.lit(1000.0)).cast("int").alias("distance_km"),
        F.coalesce(_number(F.col("value"), "approx_flight_minutes"), F.lit(120.0)).cast("int").alias("approx_flight_minutes"),
        _number(F.col("value"), "annual_pax_millions").alias("annual_pax_millions"),
        F.coalesce(_number(F.col("value"), "weight"), F.lit(0.0)).alias("weight"))
    if expect is not None:
        count = rows.agg(F.count(F.lit(1))).scalar()
        problem = F.raise_error(F.concat(F.lit(f"expected {expect} sectors, found "), count.cast("string")))
        rows = rows.withColumn("weight", F.when(count == expect, F.col("weight")).otherwise(problem.cast("double")))
    return normalise(rows)


def read_sector_weights(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return sector_weights_from(read_document(spark, path))


def window_weights_from(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """``distribution`` (``T+n`` keys), or ``days_distribution`` where that is not five long."""
    named = _entries(docs, "distribution", doc).select(
        window_days(F.col("key")).alias("advance_days"), _number(F.col("value")).alias("weight"))
    named = named.filter(F.col("advance_days").isNotNull())
    plain = _entries(docs, "days_distribution", doc).select(
        F.col("key").try_cast("int").alias("advance_days"), _number(F.col("value")).alias("weight"))
    full = named.agg(F.count_distinct("advance_days")).scalar() == 5
    return normalise(named.filter(full).unionByName(plain.filter(~full)))


def read_window_weights(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return window_weights_from(read_document(spark, path))


def carrier_shares_from(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Shares given as numbers or as objects; the packaged table where there are none."""
    rows = _entries(docs, "carrier_market_shares", doc).select(
        code("key").alias("carrier_code"),
        F.coalesce(_number(F.col("value"), "market_share"), _number(F.col("value"))).alias("market_share"))
    rows = rows.filter(F.col("market_share").isNotNull())
    found = rows.agg(F.count(F.lit(1))).scalar() > 0
    listed = F.array(*[F.struct(F.lit(c).alias("carrier_code"), F.lit(s).alias("market_share"))
                       for c, s in C.CARRIER_SHARES.items()])
    spare = docs.limit(1).select(F.inline(listed)).filter(~found)
    return rows.unionByName(spare)


def read_carrier_shares(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return carrier_shares_from(read_document(spark, path))


def sector_specs_from(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Distance and minutes per sector."""
    return sector_weights_from(docs, doc, expect=None).select("sector", "distance_km", "approx_flight_minutes")


def read_sector_specs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """From a weight file, or the packaged table."""
    if path is None:
        rows = [(s, *spec) for s, spec in C.SECTOR_SPECS.items()]
        return spark.createDataFrame(rows, "sector string, distance_km int, approx_flight_minutes int")
    return sector_specs_from(read_document(spark, path))


def dim_routes(spark: SparkSession) -> DataFrame:
    """The 30 monitored sectors."""
    rows = [(i, r[0], r[1], r[2], r[3], r[4], float(r[6]), r[9], r[10]) for i, r in enumerate(C.SECTORS, start=1)]
    return spark.createDataFrame(rows, "route_id int, sector string, origin_iata string, destination_iata string, "
                                       "origin_city string, destination_city string, distance_km double, "
                                       "route_tier string, traffic_weight double")


def dim_carriers(spark: SparkSession) -> DataFrame:
    """The five monitored carriers."""
    rows = [(i, *r[:4]) for i, r in enumerate(C.CARRIERS, start=1)]
    return spark.createDataFrame(rows, "carrier_id int, carrier_code string, carrier_name string, "
                                       "carrier_type string, market_share double")


def attach_dims(df: DataFrame) -> DataFrame:
    """``route_id`` and ``carrier_id``, null when unknown. The dimensions are the
    packaged 30 and 5 rows, so broadcasting them is bounded."""
    spark = df.sparkSession
    routes = F.broadcast(dim_routes(spark).select("sector", "route_id"))
    carriers = F.broadcast(dim_carriers(spark).select("carrier_code", "carrier_id"))
    df = df.drop("route_id", "carrier_id")
    return df.join(routes, "sector", "left").join(carriers, "carrier_code", "left")
