"""The daily, weekly and monthly publications as single plans.

Many dates cost no more plan than one: the base date is reached by moving the date of
the base rows, movements by joining the published series to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import to_places
from fareloom.operators import elementary, movements, multilateral, national, route

TIERS = {"Trunk": "tier_trunk", "High-Density": "tier_high_density", "Regional": "tier_regional", "Seasonal": "tier_seasonal"}
DATE = "travel_date"


def route_relatives(usable: DataFrame, lag_days: int = 30, date: str = DATE, **shares) -> DataFrame:
    """Stages 1 and 2 for every date against the date ``lag_days`` before."""
    elem = elementary.elementary_indices_lagged(usable, lag_days, date, sectors=C.SECTOR_CODES, windows=C.WINDOWS)
    return route.route_indices(elem, by=[date], details=False, **shares)


def quote_counts(usable: DataFrame, lag_days: int = 30, minimum: int = 10, date: str = DATE) -> DataFrame:
    """Every date with its count, and ``enough``: at least ``minimum`` quotes on both sides."""
    counts = usable.groupBy(date).agg(F.count(F.lit(1)).alias("total_quotes"))
    both = movements.offset_join(counts, {"base_quotes": lag_days}, (), date, "total_quotes")
    enough = (F.col("total_quotes") >= minimum) & (F.coalesce("base_quotes", F.lit(0)) >= minimum)
    return both.withColumn("enough", enough).drop("base_quotes")


def _published(values: DataFrame, usable: DataFrame, lag_days: int, minimum: int, date: str) -> DataFrame:
    """One row per date of ``usable``; dates without enough quotes have null values."""
    columns = [c for c in values.columns if c != date]
    counted = quote_counts(usable, lag_days, minimum, date).join(values, date, "left")
    return counted.select(date, "total_quotes", *[F.when(F.col("enough"), F.col(c)).alias(c) for c in columns])


def daily_values(usable: DataFrame, omega: DataFrame, lag_days: int = 30, minimum: int = 10, date: str = DATE) -> DataFrame:
    """One-day values: date, total_quotes and the stage 3 columns, null on thin dates."""
    cells = route_relatives(usable, lag_days, date)
    return _published(national.national_laspeyres(cells, omega, by=[date]), usable, lag_days, minimum, date)


def daily_index(usable: DataFrame, omega: DataFrame, lag_days: int = 30, minimum: int = 10, date: str = DATE) -> DataFrame:
    """Index, movements and the breakdown by tier and window, one row per date.

    The composite and all its parts come from one grouping-sets aggregate, folded into
    one row per date. Dates with too few quotes are published with null values.
    """
    parts = national.contributions(route_relatives(usable, lag_days, date), omega, by=[date])

    def part(dimension: str, member: str, column: str = "contribution") -> Column:
        return F.max(F.when((F.col("dimension") == dimension) & (F.col("member") == member), F.col(column)))

    wide = parts.groupBy(date).agg(
        to_places(part("all", "NATIONAL"), 4).alias("composite_index"), part("all", "NATIONAL", "cells").alias("cells"),
        *[to_places(part("tier", tier), 2).alias(name) for tier, name in TIERS.items()],
        *[to_places(part("window", f"T+{w}"), 2).alias(f"window_{w}") for w in C.WINDOWS])
    wide = _published(wide, usable, lag_days, minimum, date)
    size = omega.agg(F.count(F.lit(1))).scalar()
    moved = movements.daily_changes(wide, date=date, value="composite_index")
    return moved.select(
        F.col(date).alias("computation_date"), F.lit("daily").alias("frequency"),
        to_places("composite_index", 2).alias("index_value"), "change_dod_pct", "change_wow_pct", "change_mom_pct",
        "total_quotes", (size - F.col("cells")).alias("missing_cells_count"),
        *TIERS.values(), *[f"window_{w}" for w in C.WINDOWS])


def daily_sector_index(cells: DataFrame, omega: DataFrame, by: Sequence[str] = (DATE,)) -> DataFrame:
    """W14's sector part: contribution and level per sector and date."""
    return national.contributions(cells, omega, by=list(by)).filter(F.col("dimension") == "sector").select(
        *by, F.col("member").alias("sector"), "contribution", "level")


def weekly_index(daily: DataFrame, keys: Sequence[str] = ("series_id",), date: str = DATE, value: str = "composite_index") -> DataFrame:
    """A19 for every end date."""
    return movements.weekly_smooth(daily, list(keys), 7, date, value)


def monthly_index(usable: DataFrame, keys: Sequence[str] = (), length: int = 13, method: str = "mean",
                  minimum: int = 10) -> DataFrame:
    """Monthly levels, rolling multilateral series, month and year changes.

    With ``keys`` (say, sector) there is one series per key, all in one plan.
    """
    levels = movements.monthly_level(usable, keys, min_quotes=minimum).filter(F.col("level").isNotNull())
    series = F.concat_ws("|", *keys) if keys else F.lit("NATIONAL")
    levels = levels.select(series.alias("series_id"), "month", "level")
    published = multilateral.rygeks_series(levels, length=length, method=method, period="month")
    return movements.monthly_changes(published, ["series_id"], value="published_index")
