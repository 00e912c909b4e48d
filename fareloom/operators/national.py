"""Stage 3 (A8-A10, J3, J4, J16, U4): weight matrix, composite index, contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import to_places

CELL = ["sector", "advance_days"]


def normalise(weights: DataFrame, column: str = "weight") -> DataFrame:
    """Weights over their sum. The table is one row per sector or window, and the sum a
    scalar subquery, so no window without a partition is planned."""
    total = weights.agg(F.sum(column)).scalar()
    return weights.withColumn(column, F.col(column) / total)


def omega_grid(sectors: DataFrame, windows: DataFrame) -> DataFrame:
    """ω = sector weight × window weight for every cell, Σ = 1.

    ``sectors``: sector, weight and optionally route_tier; ``windows``: advance_days,
    weight. The windows become one array (five entries) exploded on each sector.
    """
    pairs = normalise(windows).agg(F.collect_list(F.struct("advance_days", "weight"))).scalar()
    tier = F.coalesce("route_tier", F.lit("Trunk")) if "route_tier" in sectors.columns else F.lit("Trunk")
    grid = normalise(sectors).select("sector", tier.alias("route_tier"), F.col("weight").alias("sector_weight"),
                                     F.explode(pairs).alias("w"))
    return grid.select("sector", F.col("w.advance_days").cast("int").alias("advance_days"), "route_tier",
                       (F.col("sector_weight") * F.col("w.weight")).alias("omega"))


def default_omega(spark: SparkSession) -> DataFrame:
    """The packaged 30 × 5 matrix, as constants (150 rows)."""
    rows = [(s, w, C.SECTOR_TIERS[s], C.SECTOR_WEIGHTS[s] * C.WINDOW_WEIGHTS[w])
            for s in sorted(C.SECTOR_CODES) for w in C.WINDOWS]
    return spark.createDataFrame(rows, "sector string, advance_days int, route_tier string, omega double")


def check_omega(omega: DataFrame) -> DataFrame:
    """The matrix's sum and whether it is 1 ± 1e-7, for callers that must stop on it."""
    return omega.agg(F.count(F.lit(1)).alias("cells"), F.sum("omega").alias("total")).withColumn(
        "is_normalised", F.abs(F.col("total") - 1.0) <= 1e-7)


def with_tier(df: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """Route tier of a sector, ``Trunk`` where it is unknown."""
    if tiers is None:
        from fareloom.functions.numeric import lookup
        return df.withColumn("route_tier", lookup("sector", C.SECTOR_TIERS, "Trunk", "string"))
    known = tiers.select("sector", F.col("route_tier").alias("tier"))
    return (df.join(known, "sector", "left")
            .withColumn("route_tier", F.coalesce("tier", F.lit("Trunk"))).drop("tier"))


def attach_cells(cells: DataFrame, omega: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All cells of the matrix for each period, observed or not (``index_value`` null)."""
    if by:
        grid = omega.agg(F.collect_list(F.struct(*omega.columns))).scalar()
        full = cells.select(*by).distinct().select(*by, F.explode(grid).alias("g")).select(*by, "g.*")
    else:
        full = omega
    return full.join(cells.select(*by, *CELL, "index_value"), [*by, *CELL], "left")


def missing_cells(cells: DataFrame, omega: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """U4: cells of the matrix that have no index."""
    return attach_cells(cells, omega, by).filter(F.col("index_value").isNull()).drop("index_value")


def _observed(cells: DataFrame, omega: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells outside the basket fall away; the matrix is small, the planner broadcasts it."""
    return cells.filter(F.col("index_value") > 0).select(*by, *CELL, "index_value").join(omega, CELL)


def national_laspeyres(
    cells: DataFrame, omega: DataFrame, by: Sequence[str] = (), impute: bool = True, fallback: float | None = None,
) -> DataFrame:
    """100·Σ ω·P, rescaled by the observed weight when cells are missing.

    Without ``impute`` an unobserved cell adds nothing, or ``fallback`` if one is given.
    """
    size = omega.agg(F.struct(F.count(F.lit(1)).alias("cells"), F.sum("omega").alias("weight"))).scalar()
    found = _observed(cells, omega, by).groupBy(*by).agg(
        F.sum(F.col("omega") * F.col("index_value") * 100.0).alias("weighted"),
        F.sum("omega").alias("observed"), F.count(F.lit(1)).alias("cells"))
    found = found.withColumn("missing_cells_count", size["cells"] - F.col("cells"))
    complete = F.col("missing_cells_count") == 0
    if impute:
        value = F.when(complete, F.col("weighted")).otherwise(F.col("weighted") / F.col("observed"))
    elif fallback is not None:
        value = F.col("weighted") + (size["weight"] - F.col("observed")) * fallback * 100.0
    else:
        value = F.col("weighted")
    return found.filter(F.col("cells") > 0).select(
        *by, to_places(value, 4).alias("composite_index"),
        to_places(value / 100.0, 6).alias("composite_relative"),
        to_places("observed", 7).alias("total_observed_weight"),
        complete.alias("is_fully_observed"), "missing_cells_count",
    )


def contributions(cells: DataFrame, omega: DataFrame, by: Sequence[str] = (), impute: bool = True) -> DataFrame:
    """A10: additive shares of the composite by sector, by window and by tier.

    One grouping-sets aggregate. ``contribution`` sums to the composite within each
    dimension; ``level`` is the index of the group itself. The row of dimension ``all``
    is the composite.
    """
    rows = _observed(cells, omega, by)
    rows = rows.withColumn("part", F.col("omega") * F.col("index_value") * 100.0)
    sets = [[*by, "sector"], [*by, "advance_days"], [*by, "route_tier"], [*by]]
    grouped = rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*by, "sector", "advance_days", "route_tier"]],
    ).agg(F.sum("part").alias("part"), F.sum("omega").alias("observed"), F.count(F.lit(1)).alias("cells"),
          F.grouping("sector").alias("no_sector"), F.grouping("advance_days").alias("no_window"),
          F.grouping("route_tier").alias("no_tier"))
    size = omega.agg(F.count(F.lit(1))).scalar()
    whole = (F.col("no_sector") == 1) & (F.col("no_window") == 1) & (F.col("no_tier") == 1)
    # one period has at most one row per sector, window and tier
    period = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    joined = grouped.withColumns({
        "dimension": F.when(whole, "all").when(F.col("no_sector") == 0, "sector")
        .when(F.col("no_window") == 0, "window").otherwise("tier"),
        "member": F.coalesce("sector", F.concat(F.lit("T+"), F.col("advance_days")), "route_tier", F.lit("NATIONAL")),
        "all_observed": F.max(F.when(whole, F.col("observed"))).over(period),
        "all_cells": F.max(F.when(whole, F.col("cells"))).over(period),
    })
    scale = F.when((F.col("all_cells") < size) & F.lit(impute), 1.0 / F.col("all_observed")).otherwise(1.0)
    return joined.select(
        *by, "dimension", "member", to_places(F.col("part") * scale, 6).alias("contribution"),
        to_places(F.col("part") / F.col("observed"), 6).alias("level"),
        to_places("observed", 7).alias("observed_weight"), "cells",
    )
