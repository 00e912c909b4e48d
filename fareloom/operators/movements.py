"""Movements of published series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import pct_change, to_places


def _at_offset(value: str, keys: Sequence[str], order: Column, offset: int) -> Column:
    """The value exactly ``offset`` units earlier: a range frame of one point, so gaps give
    null and the series is not joined to itself. Series are one row per key and date."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.max(value).over(group.orderBy(order).rangeBetween(-offset, -offset))


def _month_no(month: str) -> Column:
    return F.year(month) * 12 + F.month(month)


def offset_join(series: DataFrame, offsets: dict[str, int], keys: Sequence[str] = (), date: str = "date",
                value: str = "value") -> DataFrame:
    """The value so many calendar days earlier, one column per offset (null in gaps)."""
    return series.withColumns({
        name: _at_offset(value, keys, F.unix_date(date), days) for name, days in offsets.items()})


def month_offset_join(series: DataFrame, offsets: dict[str, int], keys: Sequence[str] = (), month: str = "month",
                      value: str = "value") -> DataFrame:
    """J12 by whole months; ``month`` is the first day of the month."""
    return series.withColumns({
        name: _at_offset(value, keys, _month_no(month), months) for name, months in offsets.items()})


def daily_changes(series: DataFrame, keys: Sequence[str] = (), date: str = "date", value: str = "value") -> DataFrame:
    """Day, week and 30-day change in percent (null when there is no earlier value)."""
    joined = offset_join(series, {"prev_1": 1, "prev_7": 7, "prev_30": 30}, keys, date, value)
    now = F.col(value)
    return joined.withColumns({
        "change_dod_pct": pct_change(now, F.col("prev_1")),
        "change_wow_pct": pct_change(now, F.col("prev_7")),
        "change_mom_pct": pct_change(now, F.col("prev_30")),
    }).drop("prev_1", "prev_7", "prev_30")


def monthly_changes(series: DataFrame, keys: Sequence[str] = (), month: str = "month", value: str = "value") -> DataFrame:
    """W10 for months: against the month before, and the year before or, in the first
    year, the first month. The first month of a series changes by 0."""
    joined = month_offset_join(series, {"prev_1": 1, "prev_12": 12}, keys, month, value)
    group = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(month)
    joined = joined.withColumns({"first_month": F.first(month).over(group), "first_value": F.first(value).over(group)})
    now = F.col(value)
    is_first = F.col(month) == F.col("first_month")
    within_year = _month_no(month) - _month_no("first_month") < 12
    return joined.withColumns({
        "change_mom_pct": F.when(is_first, 0.0).otherwise(pct_change(now, F.col("prev_1"))),
        "change_yoy_pct": F.when(is_first, 0.0).when(within_year, pct_change(now, F.col("first_value")))
        .otherwise(pct_change(now, F.col("prev_12"))),
    }).drop("prev_1", "prev_12", "first_month", "first_value")


def weekly_smooth(series: DataFrame, keys: Sequence[str], days: int = 7, date: str = "date", value: str = "value") -> DataFrame:
    """Mean of the last ``days`` calendar days, which is what daily[0] times the
    mean GEKS vector of a single level series comes to; ``days_observed`` tells gaps."""
    frame = Window.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-(days - 1), 0)
    smooth = series.withColumns({
        "weekly_value": F.avg(value).over(frame), "days_observed": F.count(value).over(frame),
        "window_start_date": F.date_sub(F.col(date), days - 1),
    })
    prior = _at_offset("weekly_value", keys, F.unix_date(date), 7)
    return smooth.withColumn("prior", prior).withColumn(
        "change_wow_pct", pct_change(F.col("weekly_value"), F.col("prior"))).drop("prior")


def history_with_band(series: DataFrame, benchmark: DataFrame | None = None, half_width: float = 1.40,
                      date: str = "date", value: str = "value") -> DataFrame:
    """The series with a fixed band and, by month, the transport benchmark."""
    out = series.withColumns({
        "composite": to_places(value, 2),
        "lower_confidence_95": to_places(F.col(value) - half_width, 2),
        "upper_confidence_95": to_places(F.col(value) + half_width, 2),
    })
    if benchmark is None:
        return out.withColumn("transport_benchmark", F.lit(None).cast("double"))
    months = benchmark.select(F.trunc("month", "month").alias("bench_month"),
                              F.col("index_value").alias("transport_benchmark"))
    return (out.withColumn("bench_month", F.trunc(date, "month")).join(months, "bench_month", "left")
            .drop("bench_month"))


def monthly_level(facts: DataFrame, keys: Sequence[str] = (), base_fare: float = C.BASE_MONTH_FARE,
                  min_quotes: int = 10, date_col: str = "travel_date") -> DataFrame:
    """Mean fare over the base month's fare × 100; null below ``min_quotes``."""
    month = F.trunc(date_col, "month").alias("month")
    grouped = facts.groupBy(*keys, month).agg(
        F.count(F.lit(1)).alias("quotes"), F.avg("total_fare").alias("avg_fare"))
    return grouped.withColumn("level", F.when(
        F.col("quotes") >= min_quotes, to_places(F.col("avg_fare") / base_fare * 100.0, 4)))


def top_movers(changes: DataFrame, n: int, change: str = "change_pct", tie: str = "sector",
               per: Sequence[str] = ()) -> DataFrame:
    """The ``n`` largest rises, overall or in each group."""
    moved = changes.filter(F.col(change).isNotNull())
    if not per:
        return moved.orderBy(F.desc(change), tie).limit(n)
    order = Window.partitionBy(*per).orderBy(F.desc(change), tie)
    return moved.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def direction(change: Column) -> Column:
    return F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")


def latest_by(series: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The newest row of each key, as one aggregate."""
    others = [c for c in series.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.col(date)).alias("row")
    return series.groupBy(*keys).agg(newest).select(*keys, "row.*")
