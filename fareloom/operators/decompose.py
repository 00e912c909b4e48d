"""A gross fare into six statutory parts."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import text
from fareloom.functions.numeric import TIE_SLACK, lookup
from fareloom.sources.schemas import FARE_PARTS, MONEY

Tariff = Mapping | DataFrame | None


def _from_table(df: DataFrame, table: DataFrame, key: str, key_value: Column, value: str, name: str) -> DataFrame:
    """Left join to a tariff table; its size is the planner's to judge, so no hint."""
    right = table.select(F.col(key).alias("tariff_key"), F.col(value).cast("double").alias(name))
    return (df.withColumn("tariff_key", key_value).join(right, "tariff_key", "left").drop("tariff_key"))


def attach_tariffs(
    df: DataFrame, udf_rates: Tariff = None, psf_rates: Tariff = None, fees: Tariff = None,
    fee_override: str | None = "raw_convenience_fee",
) -> DataFrame:
    """Add ``udf``, ``psf`` and ``fee``.

    The packaged schedules are expressions, not joins. A caller's schedule may be a
    mapping or a two-column table (origin/udf, origin/psf, source/fee). With a custom
    UDF schedule the packaged ones are not consulted, only the national default.
    """
    origin = text.code("origin_iata")
    if udf_rates is None:
        df = df.withColumn("udf", F.coalesce(lookup(origin, C.UDF_PRIMARY), lookup(origin, C.UDF_BASELINE)))
    elif isinstance(udf_rates, DataFrame):
        df = _from_table(df, udf_rates, "origin", origin, "udf", "udf")
    else:
        df = df.withColumn("udf", lookup(origin, udf_rates))
    if psf_rates is None:
        df = df.withColumn("psf", F.lit(C.PSF))
    elif isinstance(psf_rates, DataFrame):
        df = _from_table(df, psf_rates, "origin", origin, "psf", "psf")
    else:
        df = df.withColumn("psf", lookup(origin, psf_rates))
    source = text.source_name("source")
    if isinstance(fees, DataFrame):
        df = _from_table(df, fees, "source", source, "fee", "fee")
    else:
        df = df.withColumn("fee", lookup(source, C.SOURCE_FEES if fees is None else fees))
    if fee_override and fee_override in df.columns:
        df = df.withColumn("fee", F.coalesce(F.col(fee_override).cast("double"), F.col("fee")))
    return df.withColumns({
        "udf": F.coalesce("udf", F.lit(C.UDF_DEFAULT)),
        "psf": F.coalesce("psf", F.lit(C.PSF)),
        "fee": F.coalesce("fee", F.lit(0.0)),
    })


def decompose_fare(
    df: DataFrame, total: str = "raw_total_fare", gst_rate: float = C.GST_RATE, exact: bool = True, **tariffs,
) -> DataFrame:
    """Add the six parts and ``total_fare``; their sum is the total exactly.

    ``tariffs`` go to :func:`attach_tariffs`. With ``exact`` the parts are decimals,
    otherwise the doubles of the stored form.
    """
    rated = attach_tariffs(df, **tariffs)
    gross = F.col(total).cast("double")
    taxable = F.greatest(F.lit(0.0), (gross - F.col("udf") - F.col("psf") - F.col("fee")) / (1.0 + gst_rate))
    fuel = (F.when(F.col("taxable") <= 0, 0.0).when(F.col("taxable") < 400.0, F.col("taxable"))
            .otherwise(F.least(F.lit(1200.0), F.greatest(F.lit(400.0), F.col("taxable") * 0.25))))
    # whole paise: sums of integers are exact, and cheaper than decimals
    rated = rated.withColumns({"taxable": taxable, "total_fare": _paise(gross)})
    rated = rated.withColumns({
        "fuel_surcharge": _paise(fuel),
        "airport_taxes_gst": _paise(F.col("taxable") * gst_rate),
        "user_dev_fee": _paise(F.col("udf")),
        "passenger_service_fee": _paise(F.col("psf")),
        "convenience_fee": _paise(F.col("fee")),
    })
    fixed = (F.col("airport_taxes_gst") + F.col("user_dev_fee")
             + F.col("passenger_service_fee") + F.col("convenience_fee"))
    rated = rated.withColumn("left_over", F.col("total_fare") - fixed)
    short = F.col("left_over") - F.col("fuel_surcharge")
    eased = (F.when((short < 0) & (F.col("total_fare") >= int(C.FARE_FLOOR * 100)),
                    F.greatest(F.lit(0).cast("bigint"), F.col("left_over")))
             .otherwise(F.col("fuel_surcharge")))
    rated = rated.withColumn("fuel_surcharge", eased)
    rated = rated.withColumn("base_fare", F.col("left_over") - F.col("fuel_surcharge"))
    rated = rated.drop("udf", "psf", "fee", "taxable", "left_over")
    amount = _as_money if exact else (lambda name: F.col(name) / F.lit(100.0))
    return rated.withColumns({name: amount(name) for name in [*FARE_PARTS, "total_fare"]})


def _paise(value: Column) -> Column:
    """Whole paise of an amount, rounded like ``to_places(value, 2)``."""
    return F.floor(value * 100.0 + (0.5 + TIE_SLACK)).cast("bigint")


def _as_money(name: str) -> Column:
    hundredth = F.lit(Decimal("0.01")).cast("decimal(3,2)")
    return (F.col(name).cast("decimal(14,0)") * hundredth).cast(MONEY.simpleString())


def residual() -> Column:
    """|total − sum of the six parts|."""
    parts = sum((F.col(p) for p in FARE_PARTS[1:]), F.col(FARE_PARTS[0]))
    return F.abs(F.col("total_fare") - parts)


def is_balanced(tolerance: float = 1.0) -> Column:
    """P7."""
    return residual() <= F.lit(tolerance)
