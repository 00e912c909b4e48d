"""How well one series tracks another."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.functions.numeric import to_places


@dataclass(frozen=True)
class Hurdles:
    r_squared: float = 0.85
    mape_pct: float = 15.0
    concordance_pct: float = 80.0
    fill_pct: float = 95.0


def align_series(actual: DataFrame, predicted: DataFrame, other: DataFrame | None = None,
                 keys: Sequence[str] = ("date",)) -> DataFrame:
    """One row per date all series have."""
    out = actual.join(predicted, list(keys))
    return out if other is None else out.join(other, list(keys))


def r_squared(actual: Column, predicted: Column) -> Column:
    """1 − SSres/SStot, 1 for a constant actual series (an aggregate)."""
    total = F.var_pop(actual) * F.count(actual)
    return F.when(total == 0, 1.0).otherwise(1.0 - F.sum((actual - predicted) * (actual - predicted)) / total)


def mape(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs((predicted - actual) / actual)) * 100.0


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((predicted - actual) * (predicted - actual)))


def fill_rate(value: Column) -> Column:
    """Share of rows with a positive value, in percent."""
    return F.avg(F.when(value > 0, 1.0).otherwise(0.0)) * 100.0


def concordance_steps(aligned: DataFrame, a: str, b: str, keys: Sequence[str], date: str = "date") -> DataFrame:
    """W8, per step: 1.0 where both series move the same way (no move counts as a way)."""
    order = Window.partitionBy(*keys).orderBy(date)
    same = F.signum(F.col(a) - F.lag(a).over(order)) == F.signum(F.col(b) - F.lag(b).over(order))
    return aligned.withColumn("same_direction", same.cast("double"))


def directional_concordance(aligned: DataFrame, a: str, b: str, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Percentage of steps in the same direction."""
    return concordance_steps(aligned, a, b, keys, date).groupBy(*keys).agg(
        (F.avg("same_direction") * 100.0).alias("directional_concordance_pct"))


def backtest_metrics(aligned: DataFrame, keys: Sequence[str], hurdles: Hurdles = Hurdles(), date: str = "date") -> DataFrame:
    """A20 + A22 + W8 + A23 from ``actual``, ``predicted``, ``other`` per key."""
    act, pred = F.col("actual"), F.col("predicted")
    raw = concordance_steps(aligned, "predicted", "other", keys, date).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        r_squared(act, pred).alias("r2"), mape(act, pred).alias("mape"), rmse(act, pred).alias("rmse"),
        (F.avg("same_direction") * 100.0).alias("conc"), fill_rate(pred).alias("fill"))
    tests = {
        "r_squared_passed": F.col("r2") > hurdles.r_squared,
        "mape_passed": F.col("mape") < hurdles.mape_pct,
        "directional_concordance_passed": F.col("conc") >= hurdles.concordance_pct,
        "data_fill_rate_passed": F.col("fill") >= hurdles.fill_pct,
    }
    everything = F.lit(True)
    for test in tests.values():
        everything = everything & F.coalesce(test, F.lit(False))
    return raw.select(
        *keys, "days", "start_date", "end_date", to_places("r2", 4).alias("r_squared"),
        to_places("mape", 2).alias("mape_pct"), to_places("rmse", 2).alias("rmse"),
        to_places("conc", 1).alias("directional_concordance_pct"), to_places("fill", 1).alias("data_fill_rate_pct"),
        *[F.coalesce(test, F.lit(False)).alias(name) for name, test in tests.items()],
        F.when(everything, "PASSED").otherwise("FAILED").alias("verdict"),
    )


def residual_table(aligned: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The daily comparison table."""
    gap = F.col("predicted") - F.col("actual")
    return aligned.select(
        *keys, date, to_places("predicted", 2).alias("predicted_fare"), to_places("actual", 2).alias("actual_fare"),
        to_places(gap, 2).alias("residual"), to_places(F.abs(gap) / F.col("actual") * 100.0, 2).alias("pct_error"),
        to_places("other", 3).alias("benchmark"),
    )


def backtest_report(aligned: DataFrame, keys: Sequence[str], hurdles: Hurdles = Hurdles(), date: str = "date") -> DataFrame:
    """Metrics with the daily table nested per key (one entry per day)."""
    metrics = backtest_metrics(aligned, keys, hurdles, date)
    table = residual_table(aligned, keys, date)
    days = table.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(date, *[c for c in table.columns if c not in (*keys, date)]))).alias("time_series_comparison"))
    return metrics.join(days, list(keys))
