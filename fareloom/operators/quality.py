"""Outlier rules, quality score, and the cleaning pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import text
from fareloom.functions.numeric import to_places
from fareloom.operators import decompose, dedup
from fareloom.operators.normalize import handle_sold_out
from fareloom.operators.joins import join_cohort
from fareloom.operators.ranking import approx_quantiles, exact_quantiles, quantiles_of_counts
from fareloom.session import stored
from fareloom.sources.schemas import CLEAN_QUOTE

COHORT = ["sector", "advance_days", "weekday"]
QUARTILES = {"cohort_q1": 0.25, "cohort_median": 0.5, "cohort_q3": 0.75}


@dataclass(frozen=True)
class OutlierLimits:
    """thresholds of the outlier rules."""

    floor: float = C.FARE_FLOOR
    ceiling: float = C.FARE_CEILING
    surge_pct: float = 300.0
    variance_pct: float = 50.0
    min_cohort: int = 5
    flat_iqr: float = 1.0
    flat_band: float = 0.15
    fence: float = 1.5


LIMITS = OutlierLimits()


def is_floor_violation(fare: Column, limits: OutlierLimits = LIMITS) -> Column:
    return fare < limits.floor


def is_ceiling_violation(fare: Column, limits: OutlierLimits = LIMITS) -> Column:
    return fare > limits.ceiling


def is_temporal_surge(prev: Column, fare: Column, limits: OutlierLimits = LIMITS) -> Column:
    """More than ``surge_pct`` above the day before; any rise from nothing counts."""
    return F.when(prev <= 0, True).otherwise((fare - prev) / prev * 100.0 > limits.surge_pct)


def is_cross_source_variance(fare: Column, median: Column, limits: OutlierLimits = LIMITS) -> Column:
    """P16."""
    return F.when(median <= 0, True).otherwise(F.abs(fare - median) / median * 100.0 > limits.variance_pct)


def iqr_bounds(q1: Column, median: Column, q3: Column, limits: OutlierLimits = LIMITS) -> tuple[Column, Column]:
    """The fences, clamped to the fare limits; a flat cohort gets median ± 15 %."""
    flat = (q3 - q1) < limits.flat_iqr
    spread = limits.fence * (q3 - q1)
    low = F.greatest(F.lit(limits.floor), F.when(flat, median * (1.0 - limits.flat_band)).otherwise(q1 - spread))
    high = F.least(F.lit(limits.ceiling), F.when(flat, median * (1.0 + limits.flat_band)).otherwise(q3 + spread))
    known = median.isNotNull()
    return (F.when(~known, limits.floor).when(flat, F.least(low, high)).otherwise(low),
            F.when(~known, limits.ceiling).when(flat, F.greatest(low, high)).otherwise(high))


def with_cohort(df: DataFrame) -> DataFrame:
    """Sector and weekday of travel (Monday 0), the cohort of the screening rules."""
    return df.withColumns({
        "sector": F.concat_ws("-", "origin_iata", "destination_iata"),
        "weekday": F.weekday("travel_date"),
    })


def cohort_stats(
    df: DataFrame, fare: str = "raw_total_fare", keys: list[str] | None = None,
    limits: OutlierLimits = LIMITS, approximate: bool = False,
) -> DataFrame:
    """Count, quartiles and fences per cohort."""
    keys = keys or COHORT
    quantiles = approx_quantiles if approximate else exact_quantiles
    stats = quantiles(df.select(*keys, F.col(fare).cast("double").alias("fare")), keys, "fare", QUARTILES, count_as="cohort_size")
    return _with_bounds(stats, limits)


def cohort_stats_of_counts(counts: DataFrame, keys: list[str] | None = None, limits: OutlierLimits = LIMITS, folded: bool = True) -> DataFrame:
    """A14/A13 from (keys, fare, n)."""
    return _with_bounds(quantiles_of_counts(counts, keys or COHORT, "fare", QUARTILES, count_as="cohort_size", folded=folded), limits)


def _with_bounds(stats: DataFrame, limits: OutlierLimits) -> DataFrame:
    low, high = iqr_bounds(F.col("cohort_q1"), F.col("cohort_median"), F.col("cohort_q3"), limits)
    return stats.withColumns({"lower_bound": low, "upper_bound": high})


def cohort_frame(df: DataFrame, stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every row with its cohort's statistics (null where the cohort has none)."""
    return join_cohort(df, stats, keys or COHORT, "left")


def evaluate_outliers(df: DataFrame, fare: str = "raw_total_fare", limits: OutlierLimits = LIMITS) -> DataFrame:
    """``flags``, ``is_outlier``, ``outlier_reason``, ``temporal_pct_change``,
    ``cross_source_deviation_pct``; cohort and ``prev_fare`` columns are optional."""
    value = F.col(fare).cast("double")
    have = set(df.columns)
    median = F.col("cohort_median") if "cohort_median" in have else F.lit(None).cast("double")
    prev = F.col("prev_fare") if "prev_fare" in have else F.lit(None).cast("double")
    rules = [F.when(is_floor_violation(value, limits), "DOMAIN_FLOOR"),
             F.when(is_ceiling_violation(value, limits), "DOMAIN_CEILING")]
    if {"lower_bound", "upper_bound", "cohort_size"} <= have:
        outside = (value < F.col("lower_bound")) | (value > F.col("upper_bound"))
        rules.append(F.when((F.col("cohort_size") >= limits.min_cohort) & outside, "STATISTICAL_IQR"))
    rules.append(F.when((prev > 0) & is_temporal_surge(prev, value, limits), "TEMPORAL_SURGE"))
    rules.append(F.when((median > 0) & is_cross_source_variance(value, median, limits), "CROSS_SOURCE_VARIANCE"))
    return df.withColumn("flags", F.filter(F.array(*rules), lambda flag: flag.isNotNull())).withColumns({
        "is_outlier": F.size("flags") > 0,
        "outlier_reason": F.try_element_at("flags", F.lit(1)),
        "temporal_pct_change": F.when(prev > 0, (value - prev) / prev * 100.0),
        "cross_source_deviation_pct": F.when(median > 0, F.abs(value - median) / median * 100.0),
    })


def quality_score(
    df: DataFrame, fare: str = "raw_total_fare", imputed: Column | None = None, limits: OutlierLimits = LIMITS,
) -> DataFrame:
    """Struct ``dqs`` of five sub-scores, their total and the two verdicts.

    A duration of nothing is penalised like a negative one.
    """
    value = F.col(fare).cast("double")
    imputed = F.lit(False) if imputed is None else imputed
    schema = (F.lit(25.0)
              - F.when(F.coalesce(F.trim("flight_number"), F.lit("")) == "", 25.0).otherwise(0.0)
              - F.when(F.col("arrival_time").isNull(), 10.0).otherwise(0.0)
              - F.when(F.col("duration_minutes") <= 0, 15.0).otherwise(0.0))
    gap = decompose.residual()
    integrity = (F.when(gap <= 1.0, F.when(imputed, 12.0).otherwise(20.0))
                 .when(gap <= 5.0, 12.0).when(gap <= 50.0, 5.0).otherwise(0.0))
    in_bounds = value.between(limits.floor, limits.ceiling)
    bounds = F.when(~in_bounds, 0.0).when(~F.col("is_outlier"), 25.0).otherwise(10.0)
    if "cohort_median" in df.columns:
        median = F.col("cohort_median")
        off = F.abs(value - median) / median
        agreement = (F.when(median.isNull() | (median <= 0), 15.0).when(off <= 0.05, 15.0)
                     .when(off <= 0.20, 10.0).when(off <= 0.50, 5.0).otherwise(0.0))
    else:
        agreement = F.lit(15.0)
    source = text.source_name(F.coalesce("source", F.lit("airline")))
    reliability = (F.when(source.isin(C.DIRECT_SOURCES), 15.0)
                   .when(source.isin(C.AGENCY_SOURCES), 13.0).otherwise(8.0))
    parts = {
        "schema_completeness": F.greatest(F.lit(0.0), schema),
        "decomposition_integrity": integrity,
        "domain_and_bounds": bounds,
        "cross_source_concordance": agreement,
        "source_reliability": reliability,
    }
    df = df.withColumn("dqs", F.struct(*[v.alias(k) for k, v in parts.items()]))
    total = to_places(sum((F.col(f"dqs.{k}") for k in list(parts)[1:]), F.col(f"dqs.{list(parts)[0]}")), 2)
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))
    hard = F.array_contains("flags", "DOMAIN_FLOOR") | F.array_contains("flags", "DOMAIN_CEILING")
    return df.withColumn("data_quality_score", total).withColumns({
        "is_index_eligible": F.col("data_quality_score") >= 80.0,
        "is_quarantined": (F.col("data_quality_score") < 60.0) | (F.col("is_outlier") & hard),
    })


def clean_rows(df: DataFrame, **tariffs) -> DataFrame:
    """P20, the row part: sold-out, parts, outlier rules, score, verdict.

    Cohort statistics and ``prev_fare`` are used where the columns are there; without
    them only the floor and ceiling rules can fire, as in a direct store of raw quotes.
    """
    ready = handle_sold_out(df)
    ready = decompose.decompose_fare(ready, exact=False, **tariffs)
    scored = quality_score(evaluate_outliers(ready))
    return scored.withColumn("sector", F.concat_ws("-", "origin_iata", "destination_iata"))


def clean_quotes_batch(
    raw: DataFrame, deduplicate: bool = True, scope_cols: tuple[str, ...] = (), with_prev_fare: bool = False,
    approximate: bool = False, **tariffs,
) -> DataFrame:
    """P20 over a batch: W2, then A14 joined back (W4), then :func:`clean_rows`.

    Cohorts use the fares as quoted, before sold-out fares are replaced.
    """
    rows = dedup.previous_day_fare(raw) if with_prev_fare else raw
    rows = dedup.deduplicate_quotes(rows, scope_cols=scope_cols) if deduplicate else rows
    rows = stored(with_cohort(rows), "deduplicated")  # used twice: for the statistics and for the rows
    stats = cohort_stats(rows, approximate=approximate)
    return clean_rows(cohort_frame(rows, stats), **tariffs)


def clean_quotes(
    facts: DataFrame, start=None, end=None, min_dqs: float = 80.0, sector: str | None = None,
    carrier: str | None = None, window: int | None = None, date_col: str = "travel_date",
) -> DataFrame:
    """Rows fit for the index; every predicate can reach the parquet scan."""
    kept = facts.filter((F.col("data_quality_score") >= min_dqs) & ~F.col("is_outlier") & ~F.col("is_quarantined"))
    if start is not None:
        kept = kept.filter(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        kept = kept.filter(F.col(date_col) <= F.lit(end).cast("date"))
    if sector is not None:
        kept = kept.filter(F.col("sector") == sector.upper().strip())
    if carrier is not None:
        kept = kept.filter(F.col("carrier_code") == carrier.upper().strip())
    if window is not None:
        kept = kept.filter(F.col("advance_days") == window)
    return kept


def outlier_rows(facts: DataFrame, min_dqs: float = 80.0) -> DataFrame:
    """P25."""
    return facts.filter(F.col("is_outlier") & (F.col("data_quality_score") >= min_dqs))


def stored_form(clean: DataFrame) -> DataFrame:
    """The fact row: declared columns and types only."""
    present = set(clean.columns)
    return clean.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CLEAN_QUOTE.fields
    ])
