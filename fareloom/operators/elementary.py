"""Stage 1 (A1-A4, J1, J5, U1, U3, W1): Jevons indices of (sector, carrier, window) cohorts.

All cohorts and all periods are computed by one plan. Quotes pair on (cohort, flight,
departure, k): ``k`` is part of the key, so a flight that is quoted very often is spread
over tasks instead of meeting in one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fareloom.functions import text
from fareloom.functions.numeric import to_places
from fareloom.operators.ranking import occurrence_no

COHORT = ["sector", "carrier_code", "advance_days"]
FLIGHT = ["flight", "departs"]


def prepare(df: DataFrame, period: str | None, fare: str = "total_fare", extra: Sequence[str] = ()) -> DataFrame:
    """The narrow rows the stage needs: cohort, flight identity, fare, order columns.

    Codes are taken as P1 and the fact table hold them, so they are not tidied again.
    """
    sector = F.col("sector") if "sector" in df.columns else F.concat_ws("-", "origin_iata", "destination_iata")
    optional = {
        "flight": text.code("flight_number") if "flight_number" in df.columns else F.lit(""),
        "departs": F.trim("departure_time") if "departure_time" in df.columns else F.lit(""),
    }
    return df.select(
        *([period] if period else []), sector.alias("sector"), "carrier_code",
        F.col("advance_days").cast("int").alias("advance_days"),
        *[F.coalesce(v, F.lit("")).alias(k) for k, v in optional.items()],
        F.col(fare).cast("double").alias("fare"), *extra,
    )


def geometric_means(df: DataFrame, keys: Sequence[str], value: str = "fare") -> DataFrame:
    """A1 per group: rows, usable rows and mean log; ``exp(log_mean)`` is the geometric mean."""
    usable = F.col(value) > 0
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("quotes"),
        F.sum(usable.cast("bigint")).alias("usable"),
        F.avg(F.when(usable, F.ln(value))).alias("log_mean"),
    )


def jevons(log_mean_base: Column, log_mean_current: Column) -> Column:
    """A2: mean log relative = difference of mean logs, for equal and unequal counts alike."""
    return F.exp(log_mean_current - log_mean_base)


def number_quotes(rows: DataFrame, period: Sequence[str], day: str, tie: str) -> DataFrame:
    """W1 over usable fares: the arrival number of a quote among its flight's quotes."""
    return occurrence_no(rows.filter(F.col("fare") > 0), [*period, *COHORT, *FLIGHT], day, tie, near=[*COHORT, *FLIGHT])


def _narrow(df: DataFrame, sectors: Sequence[str] | None, windows: Sequence[int] | None) -> DataFrame:
    if sectors:
        df = df.filter(F.col("sector").isin(list(sectors)))
    if windows:
        df = df.filter(F.col("advance_days").isin(list(windows)))
    return df


def _against(rows: DataFrame, period: str, base: Callable[[Column, WindowSpec], Column], match: bool,
             day: str, tie: str) -> DataFrame:
    """A4 in one pass: ``base(value, group)`` gives a row the base period's value in its group.

    The base quote of a pair is fetched by a window over (cohort, flight, k), which holds
    one row per period, so there is no self-join. One aggregate then gives the counts,
    the geometric means and the matched mean of every (period, cohort); the base mean is
    fetched the same way from that small table.
    """
    rows = rows.withColumn("usable", F.col("fare") > 0)
    if match:
        # a flight's rows of all periods lie together, so the pairs below need no further shuffle
        rows = occurrence_no(rows, [period, *COHORT, *FLIGHT, "usable"], day, tie, near=[*COHORT, *FLIGHT, "usable"])
        pair = Window.partitionBy(*COHORT, *FLIGHT, "usable", "occurrence")
        rows = rows.withColumn("base_fare", base(F.col("fare"), pair))
        gap = F.when(F.col("usable"), F.ln("fare") - F.ln("base_fare"))
    else:
        gap = F.lit(None).cast("double")
    grouped = rows.groupBy(period, *COHORT).agg(
        F.count(F.lit(1)).alias("quotes"), F.avg(F.when(F.col("usable"), F.ln("fare"))).alias("log_mean"),
        F.count(gap).alias("matched_quote_count"), F.avg(gap).alias("matched_log"))
    cohort = Window.partitionBy(*COHORT)
    both = grouped.withColumns({
        "base_log": base(F.col("log_mean"), cohort), "base_quote_count": base(F.col("quotes"), cohort)})
    index = F.coalesce(F.exp("matched_log"), jevons(F.col("base_log"), F.col("log_mean")))
    return both.filter(F.col("base_log").isNotNull() & F.col("log_mean").isNotNull()).select(
        period, *COHORT, "base_quote_count", F.col("quotes").alias("current_quote_count"), "matched_quote_count",
        to_places(F.exp("base_log"), 4).alias("base_geometric_mean"),
        to_places(F.exp("log_mean"), 4).alias("current_geometric_mean"), to_places(index, 6).alias("index_value"))


def elementary_indices(
    quotes: DataFrame, period: str, base, fare: str = "total_fare", match: bool = True,
    sectors: Sequence[str] | None = None, windows: Sequence[int] | None = None,
    day: str = "travel_date", tie: str = "quote_id",
) -> DataFrame:
    """A4 against one fixed base period, for every period of ``quotes`` at once."""
    extra = [c for c in (day, tie) if c != period]
    rows = _narrow(prepare(quotes, period, fare, extra), sectors, windows)
    is_base = F.col(period) == F.lit(base)
    return _against(rows, period, lambda value, group: F.max(F.when(is_base, value)).over(group),
                    match, day, tie)


def elementary_indices_lagged(
    quotes: DataFrame, lag_days: int = 30, period: str = "travel_date", fare: str = "total_fare",
    match: bool = True, sectors: Sequence[str] | None = None, windows: Sequence[int] | None = None,
    tie: str = "quote_id",
) -> DataFrame:
    """A4 for every date against the date ``lag_days`` before it, by a range frame on the day."""
    rows = _narrow(prepare(quotes, period, fare, [tie]), sectors, windows)

    def base(value: Column, group: WindowSpec) -> Column:
        return F.max(value).over(group.orderBy(F.unix_date(period)).rangeBetween(-lag_days, -lag_days))

    return _against(rows, period, base, match, period, tie)


def _two_sides(base: DataFrame, current: DataFrame, fare: str, extra: Sequence[str]) -> DataFrame:
    """Both sets as one, with ``side`` 0 for the base, so that what follows reads each once."""
    sides = [prepare(df, None, fare, extra).withColumn("side", F.lit(k)) for k, df in enumerate((base, current))]
    return sides[0].unionByName(sides[1])


def match_flights(base: DataFrame, current: DataFrame, fare: str = "total_fare",
                  day: str = "travel_date", tie: str = "quote_id") -> DataFrame:
    """K-th base quote of a flight with its k-th current quote.

    Both sides are numbered in one pass and meet in an aggregate, at most two rows a key.
    """
    rows = number_quotes(_two_sides(base, current, fare, [day, tie]), ["side"], day, tie)
    fares = [F.max(F.when(F.col("side") == k, F.col("fare"))).alias(name) for k, name in enumerate(("base_fare", "current_fare"))]
    return rows.groupBy(*COHORT, *FLIGHT, "occurrence").agg(*fares).dropna(subset=["base_fare", "current_fare"])


def jevons_of_two(base: DataFrame, current: DataFrame, fare: str = "total_fare", match: bool = True,
                  day: str = "travel_date", tie: str = "quote_id") -> DataFrame:
    """A3: A4 for two given sets of quotes, as the two periods of one pass.

    The index of a cohort is that of its matched pairs where any exist, else the ratio of
    geometric means.
    """
    is_base = F.col("side") == 0
    both = _against(_two_sides(base, current, fare, [day, tie]), "side",
                    lambda value, group: F.max(F.when(is_base, value)).over(group), match, day, tie)
    return both.filter(~is_base).drop("side")


def cohort_keys(base: DataFrame, current: DataFrame, keys: Sequence[str] = COHORT) -> DataFrame:
    """Keys seen in either period."""
    return base.select(*keys).union(current.select(*keys)).distinct()


def active_keys(base: DataFrame, current: DataFrame, keys: Sequence[str] = COHORT) -> DataFrame:
    """Keys seen in both periods."""
    return base.select(*keys).intersect(current.select(*keys))
