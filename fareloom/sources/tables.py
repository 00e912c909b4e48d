"""Quote views over the order-line tables the checks run on.

The tables hold no fares, so a quote is derived from each order line by plain column
arithmetic: no join and no shuffle, and only the columns a query uses are read. Fares
are whole paise. The same arithmetic is written as SQL in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.operators.normalize import normalize_quotes, validate_quotes
from fareloom.operators.quality import clean_quotes
from fareloom.sources.schemas import MONEY

# 30 monitored sectors, one that is invalid and one outside the basket
SECTOR_RING = [*C.SECTOR_CODES, "DEL-DEL", "NAG-BOM"]
# lead-time multiplier in percent, by window
FARE_STEPS = [285, 185, 135, 108, 100]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def raw_quotes_of(lines: DataFrame) -> DataFrame:
    """A raw quote per order line, with the untidiness real sources have."""
    paise = F.when(F.col("unpriced"), F.lit(0)).otherwise(F.col("paise"))
    amount = paise.cast("decimal(10,0)") * F.lit("0.01").cast("decimal(3,2)")
    return _derived(lines).withColumn("total_fare", amount.cast(MONEY)).drop("paise", "unpriced", "ring", "number")


def _derived(lines: DataFrame) -> DataFrame:
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ring = _pick(SECTOR_RING, (part * 3 + supp) % 32)
    carrier = _pick(C.CARRIER_CODES, supp % 5)
    window = F.col("l_linenumber") % 5
    cents = F.rint(F.col("l_extendedprice") * 100)
    usual = F.floor((F.floor(cents / 16) + 200000) * _pick(FARE_STEPS, window) / 100)
    paise = F.when(order % 53 == 0, F.floor(cents / 4)).otherwise(usual)
    unpriced = (order % 11 == 0) & (F.col("l_quantity").cast("int") % 10 == 0)
    number = (part % 40 + 100).cast("string")
    direct = _pick([row[4] for row in C.CARRIERS], supp % 5)
    travel = F.to_date("l_shipdate")
    days = _pick(C.WINDOWS, window)
    leaves = (part % 40 + 8) * 30
    lasts = F.when(order % 97 == 0, 0).otherwise((part % 7) * 15 + 60)

    def clock(minutes: Column) -> Column:
        return F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"),
                        F.lpad((minutes % 60).cast("string"), 2, "0"))

    origin = F.substring(ring, 1, 3)
    shipped = F.date_format("l_shipdate", "yyyy-MM-dd")
    return lines.select(
        F.concat_ws("-", order, "l_linenumber", part, supp, cents.cast("bigint"), shipped).alias("quote_id"),
        F.when(part % 9 < 5, direct).otherwise(_pick(C.AGENCIES, part % 9 - 5)).alias("source"),
        F.when(part % 9 < 5, "airline").otherwise("ota").alias("source_type"),
        F.timestamp_add("MINUTE", ((order % 24) * 60 + part % 60).cast("int"),
                        F.date_sub(travel, days).cast("timestamp")).alias("scrape_timestamp"),
        F.when(order % 7 == 0, F.concat(F.lower(origin), F.lit(" "))).otherwise(origin).alias("origin"),
        F.substring(ring, 5, 3).alias("destination"),
        carrier.alias("carrier"),
        F.when(order % 3 == 0, F.concat(F.lower(carrier), F.lit(" "), number))
        .otherwise(F.concat(carrier, F.lit("-"), number)).alias("flight_number"),
        clock(leaves).alias("departure_time"),
        F.when(order % 89 != 0, clock((leaves + lasts) % 1440)).alias("arrival_time"),
        travel.alias("travel_date"), days.alias("advance_days"), lasts.cast("int").alias("duration_minutes"),
        (F.col("l_linenumber") % 2).alias("stops"),
        F.when(order % 50 == 0, F.lit(99)).cast(MONEY).alias("convenience_fee"),
        paise.cast("bigint").alias("paise"), unpriced.alias("unpriced"), ring.alias("ring"), number.alias("number"),
        (F.col("l_quantity").cast("int") % 10).alias("seats_available"),
        F.lit(False).alias("is_sold_out"),
    )


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_quotes_of(table(spark, sf_dir, "lineitem"))


def normalized_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 of the raw quotes."""
    return normalize_quotes(raw_quotes(spark, sf_dir))


def valid_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2's valid side."""
    return validate_quotes(normalized_quotes(spark, sf_dir))[0]


def facts_of(lines: DataFrame) -> DataFrame:
    """The fact table as a direct store of raw quotes would hold it, fare parts apart.

    Index queries scan a stored fact table, so this view has the stored columns as short
    expressions of the order line; ``operators.quality`` has the rules they come from.
    Lines that cleaning rejects are left out.
    """
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    raw = _derived(lines).filter(((part * 3 + supp) % 32 != 30) & (order % 97 != 0) & (order % 89 != 0))
    shown = raw.select(
        "quote_id", "scrape_timestamp", F.col("ring").alias("sector"), F.substring("ring", 1, 3).alias("origin_iata"),
        F.col("destination").alias("destination_iata"), F.col("carrier").alias("carrier_code"), "source", "source_type",
        "travel_date", "advance_days", F.concat("carrier", F.lit("-"), "number").alias("flight_number"), "departure_time",
        F.when(F.col("unpriced"), C.SOLD_OUT_FARE).otherwise(F.col("paise") / F.lit(100.0)).alias("total_fare"),
        "seats_available", (F.col("seats_available") == 0).alias("is_sold_out"))
    low, high = F.col("total_fare") < C.FARE_FLOOR, F.col("total_fare") > C.FARE_CEILING
    source_points = F.when(F.col("source_type") == "airline", 15.0).otherwise(13.0)
    return shown.withColumns({
        "is_outlier": low | high, "is_quarantined": low | high,
        "outlier_reason": F.when(low, "DOMAIN_FLOOR").when(high, "DOMAIN_CEILING"),
        "data_quality_score": F.when(low | high, 60.0).otherwise(85.0) + source_points,
    })


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "lineitem"))


def usable_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 of the facts, within the basket."""
    return clean_quotes(facts(spark, sf_dir)).filter(F.col("sector").isin(C.SECTOR_CODES))


def region_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region-pair view with published check values: origin is the supplier's region,
    destination the customer's. Supplier, customer and nation meet by plain joins whose
    strategy the planner picks from their size."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    lines = table(spark, sf_dir, "lineitem")
    supplier = (table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("o")))
    customer = (table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("d")))
    buyers = (table(spark, sf_dir, "orders").join(customer, "o_custkey")
              .select(F.col("o_orderkey").alias("l_orderkey"), "d"))
    joined = lines.join(supplier, "l_suppkey").join(buyers, "l_orderkey").filter(F.col("o") != F.col("d"))
    cents = F.floor(F.round(F.col("l_extendedprice") * 100) / 4)
    carrier = F.concat(F.lit("C"), F.col("l_suppkey") % 5)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents,
                    F.date_format("l_shipdate", "yyyy-MM-dd")).alias("quote_id"),
        F.concat(F.lit("R"), "o", F.lit("-R"), "d").alias("sector"), carrier.alias("carrier_code"),
        _pick(C.WINDOWS, F.col("l_linenumber") % 5).alias("advance_days"),
        F.concat(carrier, F.lit("-"), F.col("l_partkey") % 40).alias("flight_number"),
        F.to_date("l_shipdate").alias("travel_date"), F.year("l_shipdate").alias("year"),
        (cents / 100).alias("total_fare"))


REGION_SHARES = {"C0": 0.62, "C1": 0.14, "C2": 0.07, "C3": 0.05, "C4": 0.04}


def cpi_records_of(orders: DataFrame) -> DataFrame:
    """A price record per order, in the text form such records arrive in."""
    key = F.col("o_orderkey")
    kind = key % 4
    return orders.select(
        key.alias("record_id"), F.lit("2024").alias("base_year"),
        F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "MMMM").alias("month"),
        F.when(F.col("o_custkey") % 3 == 0, "All India").otherwise("Delhi").alias("state"),
        F.when(F.col("o_custkey") % 2 == 0, "Combined").when(F.col("o_custkey") % 5 != 0, "Urban").alias("sector"),
        _pick(["Transport", "Transport", "CPI (General)", "Food"], kind).alias("division"),
        _pick([C.CPI_AIRFARE_CODE, C.CPI_TRANSPORT_CODE, "00", "01"], kind).alias("code"),
        F.col("o_orderpriority").alias("class"),
        F.when(key % 13 == 0, "n/a").otherwise(
            (F.floor(F.round(F.col("o_totalprice") * 100) / 1000) / 100).cast("string")).alias("index"),
        F.when(key % 7 == 0, "-").otherwise((key % 50).cast("string")).alias("inflation"))
