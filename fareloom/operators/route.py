"""Stage 2 (A5-A7, J6, U2): Törnqvist index of a (sector, window) over its carriers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import lookup, to_places

CELL = ["sector", "advance_days"]
Shares = Mapping | DataFrame | None


def _with_share(df: DataFrame, shares: Shares, name: str) -> DataFrame:
    """Market share by carrier; .05 for a carrier the table lacks."""
    if isinstance(shares, DataFrame):
        table = shares.select("carrier_code", F.col("market_share").cast("double").alias(name))
        df = df.join(table, "carrier_code", "left")
        return df.withColumn(name, F.coalesce(name, F.lit(C.UNKNOWN_CARRIER_SHARE)))
    table = C.CARRIER_SHARES if shares is None else shares
    return df.withColumn(name, lookup("carrier_code", table, C.UNKNOWN_CARRIER_SHARE))


def tornqvist(log_index: Column, w0: Column, wt: Column) -> Column:
    """A5 as an aggregate: weights are normalised over the rows of the group."""
    return F.exp(0.5 * (F.sum(w0 * log_index) / F.sum(w0) + F.sum(wt * log_index) / F.sum(wt)))


def route_indices(
    elementary: DataFrame, by: Sequence[str] = (), shares_base: Shares = None, shares_current: Shares = None,
    known: Sequence[str] = tuple(C.CARRIER_CODES), details: bool = True,
) -> DataFrame:
    """Every cell in one aggregate over its active carriers."""
    active = elementary.filter(F.col("index_value") > 0)
    active = _with_share(active, shares_base, "w0")
    active = _with_share(active, shares_base if shares_current is None else shares_current, "wt")
    value = tornqvist(F.ln("index_value"), F.col("w0"), F.col("wt"))
    aggregates = [
        to_places(value, 6).alias("index_value"),
        F.count(F.lit(1)).alias("carriers"),
    ]
    if not details:
        return active.groupBy(*by, *CELL).agg(*aggregates)
    # at most one entry per carrier of the sector
    entry = F.struct("carrier_code", "index_value", "w0", "wt")
    grouped = active.groupBy(*by, *CELL).agg(
        *aggregates, F.sum("w0").alias("sum_w0"), F.sum("wt").alias("sum_wt"),
        F.array_sort(F.collect_list(entry)).alias("entries"))

    def weights(number: Column) -> Column:
        return F.map_from_arrays(F.col("active_carriers"), number)

    base = F.transform("entries", lambda e: to_places(e["w0"] / F.col("sum_w0"), 6))
    current = F.transform("entries", lambda e: to_places(e["wt"] / F.col("sum_wt"), 6))
    grouped = grouped.withColumn("active_carriers", F.transform("entries", lambda e: e["carrier_code"]))
    return grouped.select(
        *by, *CELL, "active_carriers",
        weights(F.transform("entries", lambda e: e["index_value"])).alias("carrier_indices"),
        weights(base).alias("carrier_weights_base"),
        weights(current).alias("carrier_weights_curr"),
        weights(F.zip_with(base, current, lambda x, y: to_places((x + y) * 0.5, 6))).alias("carrier_average_weights"),
        "index_value", (F.col("carriers") == 1).alias("is_monopoly"),
        F.array_except(F.array(*[F.lit(c) for c in known]), F.col("active_carriers")).alias("missing_carriers"),
    )


def carrier_weights(routes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The maps of :func:`route_indices` as rows."""
    return routes.select(
        *by, *CELL, F.explode("carrier_average_weights").alias("carrier_code", "average_weight"),
        "carrier_weights_base", "carrier_weights_curr", "carrier_indices",
    ).select(
        *by, *CELL, "carrier_code", "average_weight",
        F.col("carrier_weights_base")[F.col("carrier_code")].alias("weight_base"),
        F.col("carrier_weights_curr")[F.col("carrier_code")].alias("weight_current"),
        F.col("carrier_indices")[F.col("carrier_code")].alias("index_value"),
    )


def known_or_seen(elementary: DataFrame, by: Sequence[str] = (), known: Sequence[str] = tuple(C.CARRIER_CODES)) -> DataFrame:
    """Per cell, the known carriers and any other that was seen."""
    cells = elementary.select(*by, *CELL).distinct()
    listed = cells.withColumn("carrier_code", F.explode(F.array(*[F.lit(c) for c in known])))
    return listed.union(elementary.select(*by, *CELL, "carrier_code")).distinct()


def missing_carriers(elementary: DataFrame, by: Sequence[str] = (), known: Sequence[str] = tuple(C.CARRIER_CODES)) -> DataFrame:
    """Carriers known or seen in a cell that have no index there."""
    keys = [*by, *CELL, "carrier_code"]
    active = elementary.filter(F.col("index_value") > 0).select(*keys)
    return known_or_seen(elementary, by, known).join(active, keys, "left_anti")
