"""P11, P12, P21-P24, P27, A17, A21, A24-A28, A30, J9, J10, J13-J15, T3, D2-D4, D6-D8, D10."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import lookup, to_places
from fareloom.functions.text import code, source_name
from fareloom.operators.joins import join_cohort
from fareloom.session import stored

USABLE = "data_quality_score >= 80 and not is_outlier"


def query_quotes(df: DataFrame, origin: str, destination: str, travel_date=None, advance_days: int | None = None,
                 carrier: str | None = None, source: str | None = None) -> DataFrame:
    """Conjunctive filter on plain columns."""
    kept = df.filter((F.col("origin_iata") == origin.upper().strip())
                     & (F.col("destination_iata") == destination.upper().strip()))
    if travel_date is not None:
        kept = kept.filter(F.col("travel_date") == F.lit(travel_date).cast("date"))
    if advance_days is not None:
        kept = kept.filter(F.col("advance_days") == advance_days)
    if carrier is not None:
        kept = kept.filter(F.col("carrier_code") == carrier.upper().strip())
    if source is not None:
        kept = kept.filter(F.col("source") == source.lower().strip())
    return kept


def search_fares(df: DataFrame, origin: str, destination: str, min_price: float = 3000.0,
                 max_price: float = 8000.0) -> DataFrame:
    """Quotes of a pair in a price range; :func:`fare_stats` gives the summary."""
    if min_price > max_price:
        raise ValueError("min_price cannot exceed max_price")
    return query_quotes(df, origin, destination).filter(F.col("total_fare").between(min_price, max_price))


def fare_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A21."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_quotes"), F.count_distinct("sector").alias("monitored_routes"),
        F.count_distinct("carrier_code").alias("monitored_carriers"),
        to_places(F.avg("total_fare"), 2).alias("average_fare"), F.min("total_fare").alias("min_fare"),
        F.max("total_fare").alias("max_fare"), to_places(F.avg("data_quality_score"), 2).alias("average_dqs"))


def route_summary(facts: DataFrame, sector: str | None = None, window: int | None = None, travel_date=None) -> DataFrame:
    """Fares by carrier on a route; with no sector, for every route at once."""
    kept = facts.filter(USABLE)
    if sector is not None:
        kept = kept.filter(F.col("sector") == sector.upper().strip())
    if window is not None:
        kept = kept.filter(F.col("advance_days") == window)
    if travel_date is not None:
        kept = kept.filter(F.col("travel_date") == F.lit(travel_date).cast("date"))
    return kept.groupBy("sector", "carrier_code").agg(
        F.count(F.lit(1)).alias("count"), to_places(F.avg("total_fare"), 2).alias("avg_fare"),
        to_places(F.min("total_fare"), 2).alias("min_fare"), to_places(F.max("total_fare"), 2).alias("max_fare"))


def lead_time_curve(facts: DataFrame) -> DataFrame:
    """A24, the points: mean fare per window and its level against T+45 = 100."""
    points = facts.groupBy("sector", "advance_days").agg(F.avg("total_fare").alias("fare"), F.count(F.lit(1)).alias("quotes"))
    anchor = F.max(F.when(F.col("advance_days") == 45, F.col("fare"))).over(Window.partitionBy("sector"))
    return points.withColumn("relative_index", F.col("fare") / anchor * 100.0)


def elasticity(facts: DataFrame) -> DataFrame:
    """A24, the measures of a sector's curve."""
    points = lead_time_curve(facts)

    def at(days: int) -> Column:
        return F.max(F.when(F.col("advance_days") == days, F.col("fare")))

    return points.groupBy("sector").agg(
        to_places(at(1) / at(45), 4).alias("t1_to_t45_ratio"),
        to_places((at(1) / at(7) - 1.0) * 100.0, 4).alias("last_week_surge_pct"),
        to_places(F.regr_slope(F.ln("fare"), F.col("advance_days").cast("double")), 6).alias("exponential_decay_rate"))


def carrier_comparison(facts: DataFrame) -> DataFrame:
    """Mean fare, count and share of quotes per carrier of a sector, with its name."""
    grouped = facts.groupBy("sector", "carrier_code").agg(
        F.avg("total_fare").alias("fare"), F.count(F.lit(1)).alias("quotes"))
    whole = F.sum("quotes").over(Window.partitionBy("sector"))
    names = {row[0]: row[1] for row in C.CARRIERS}
    return grouped.select(
        "sector", "carrier_code", lookup("carrier_code", names, None, "string").alias("carrier_name"),
        lookup("carrier_code", C.CARRIER_SHARES, C.UNKNOWN_CARRIER_SHARE).alias("market_share"),
        to_places("fare", 2).alias("average_fare"), "quotes",
        to_places(F.col("quotes") * 100.0 / whole, 4).alias("quote_share_pct"))


def best_booking_window(facts: DataFrame) -> DataFrame:
    """Cheapest window of a sector, its saving on the mean window, the price of T+1."""
    points = facts.groupBy("sector", "advance_days").agg(F.avg("total_fare").alias("fare"))
    best = points.groupBy("sector").agg(
        F.min_by("advance_days", F.struct("fare", "advance_days")).alias("days"), F.min("fare").alias("least"),
        F.avg("fare").alias("mean"), F.max(F.when(F.col("advance_days") == 1, F.col("fare"))).alias("last"))
    return best.select(
        "sector", F.concat(F.lit("T+"), F.col("days")).alias("recommended_window"),
        to_places((1.0 - F.col("least") / F.col("mean")) * 100.0, 2).alias("average_saving_pct"),
        to_places((F.col("last") / F.col("least") - 1.0) * 100.0, 2).alias("last_minute_penalty_pct"))


def route_detail(routes: DataFrame, facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per sector with its window curve and its carriers nested."""
    curve = lead_time_curve(facts).select("sector", "advance_days", to_places("fare", 2).alias("average_fare"))
    windows = (routes.select(*by, "sector", "advance_days", to_places(F.col("index_value") * 100.0, 2).alias("index"))
               .join(curve, ["sector", "advance_days"], "left").groupBy(*by, "sector")
               .agg(F.array_sort(F.collect_list(F.struct("advance_days", "index", "average_fare"))).alias("advance_windows")))
    carriers = carrier_comparison(facts).groupBy("sector").agg(F.array_sort(F.collect_list(
        F.struct("carrier_code", "carrier_name", "market_share", "average_fare"))).alias("carrier_shares"))
    specs = {k: v[0] for k, v in C.SECTOR_SPECS.items()}
    return windows.join(carriers, "sector", "left").withColumns({
        "distance_km": lookup("sector", specs, C.DEFAULT_SPEC[0], "int"),
        "route_tier": lookup("sector", C.SECTOR_TIERS, "Trunk", "string"),
        "route_weight": lookup("sector", C.SECTOR_WEIGHTS, 0.0),
    })


def attach_income(df: DataFrame, incomes: DataFrame | None = None) -> DataFrame:
    """Annual income at both ends, with the default where it is unknown."""
    if incomes is None:
        return df.withColumns({"income_origin": lookup("origin_iata", C.INCOMES, C.DEFAULT_INCOME),
                               "income_destination": lookup("destination_iata", C.INCOMES, C.DEFAULT_INCOME)})
    for end in ("origin", "destination"):
        side = incomes.select(F.col("airport").alias(f"{end}_iata"), F.col("annual_income").alias(f"income_{end}"))
        df = df.join(side, f"{end}_iata", "left").withColumn(
            f"income_{end}", F.coalesce(f"income_{end}", F.lit(C.DEFAULT_INCOME)))
    return df


def affordability(df: DataFrame, incomes: DataFrame | None = None, fare: str = "average_fare") -> DataFrame:
    """Wage days for a ticket, score (5 days = 100) and rating."""
    joined = attach_income(df, incomes)
    daily = (F.col("income_origin") + F.col("income_destination")) / 2.0 / 365.0
    days = F.when(daily > 0, F.col(fare) / daily).otherwise(5.0)
    score = to_places(F.lit(5.0) / days * 100.0, 1)
    rated = joined.withColumns({
        "daily_income": to_places(daily, 2), "wage_days_required": to_places(days, 1), "affordability_score": score,
    })
    s = F.col("affordability_score")
    return rated.withColumn("affordability_rating", F.when(s >= 120, "Very Affordable").when(s >= 90, "Affordable")
                            .when(s >= 70, "Moderate").otherwise("High Cost Barrier")
                            ).drop("income_origin", "income_destination")


def national_affordability(facts: DataFrame, incomes: DataFrame | None = None) -> DataFrame:
    """P21 on the mean fare of every route."""
    means = facts.groupBy("origin_iata", "destination_iata").agg(F.avg("total_fare").alias("average_fare"))
    return affordability(means, incomes).withColumn("average_fare", to_places("average_fare", 2))


def income_ratio(df: DataFrame, incomes: DataFrame | None = None, fare: str = "average_fare") -> DataFrame:
    """Fare as a percentage of the origin's annual income."""
    return attach_income(df, incomes).withColumn(
        "fare_to_income_pct", to_places(F.col(fare) / F.col("income_origin") * 100.0, 4)
    ).drop("income_origin", "income_destination")


def hours_to_fly(df: DataFrame, hourly_wage: float = 150.0, fare: str = "total_fare", limit: float = 40.0) -> DataFrame:
    """D4."""
    hours = F.col(fare) / hourly_wage
    return df.withColumns({"hours_to_fly": to_places(hours, 4), "is_strained": hours > limit})


def shock_response(atf_change_pct: Column, demand_shock_pct: Column) -> Column:
    return atf_change_pct * C.FUEL_ELASTICITY + demand_shock_pct * C.DEMAND_ELASTICITY


def cpi_impact(df: DataFrame, change: str = "change_pct") -> DataFrame:
    """Percentage change to basis points of transport and of the headline index."""
    bps = F.col(change) * C.AIRFARE_SHARE_OF_TRANSPORT * 100.0
    return df.withColumns({
        "transport_impact_bps": to_places(bps, 2),
        "headline_impact_bps": to_places(bps * C.TRANSPORT_SHARE_OF_HEADLINE, 2),
    })


def scenario_projection(scenarios: DataFrame, baseline: Column) -> DataFrame:
    """``atf_change_pct`` and ``demand_shock_pct`` per row to index and index points.

    ``baseline`` is a level: a column of ``scenarios`` or a scalar subquery.
    """
    delta = shock_response(F.col("atf_change_pct"), F.col("demand_shock_pct"))
    moved = scenarios.withColumns({"delta_raw": delta, "baseline_raw": baseline})
    moved = cpi_impact(moved, "delta_raw")
    return moved.withColumns({
        "baseline_index": to_places("baseline_raw", 2), "delta_pct": to_places("delta_raw", 2),
        "projected_index": to_places(F.col("baseline_raw") * (F.lit(1.0) + F.col("delta_raw") / 100.0), 2),
    }).drop("delta_raw", "baseline_raw")


def scenario_fares(route_fares: DataFrame, scenarios: Sequence[tuple[str, float, float]]) -> DataFrame:
    """P22, by route: each route's fare under each named scenario (a parameter list)."""
    listed = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(a)).alias("atf"), F.lit(float(d)).alias("demand"))
                       for n, a, d in scenarios])
    rows = route_fares.withColumn("s", F.explode(listed))
    part = shock_response(F.col("s.atf"), F.col("s.demand")) / 100.0
    return rows.select(
        *route_fares.columns, F.col("s.scenario").alias("scenario"),
        to_places(F.col("average_fare") * part, 1).alias("delta_fare"),
        to_places(F.col("average_fare") * (F.lit(1.0) + part), 1).alias("projected_fare"))


def forecast(base: DataFrame, days: int = 14, atf_trend_pct: float = 0.5, date: str = "date", value: str = "value") -> DataFrame:
    """Each base row projected ``days`` ahead with drift, weekday factor and band."""
    ahead = base.withColumn("day_offset", F.explode(F.sequence(F.lit(1), F.lit(days))))
    ahead = ahead.withColumn("forecast_date", F.date_add(F.col(date), F.col("day_offset")))
    factor = F.get(F.array(*[F.lit(f) for f in C.WEEKDAY_FACTORS]), F.weekday("forecast_date"))
    daily = atf_trend_pct * C.FUEL_ELASTICITY / 30.0
    point = F.col(value) * (F.lit(1.0) + F.col("day_offset") * daily / 100.0) * factor
    band = F.col("day_offset") * 0.15 + 0.85
    return ahead.withColumns({
        "day_name": F.date_format("forecast_date", "EEEE"), "projected": to_places(point, 2),
        "lower_confidence_95": to_places(point - band, 2), "upper_confidence_95": to_places(point + band, 2),
        "seasonality_factor": factor,
    })


def attach_coords(df: DataFrame, coords: DataFrame | None = None) -> DataFrame:
    """City and point at both ends, with a default point where unknown."""
    fixed = {"origin": C.DEFAULT_POINT_FROM, "destination": C.DEFAULT_POINT_TO}
    for end, (lat, lon) in fixed.items():
        if coords is None:
            key = f"{end}_iata"
            df = df.withColumns({
                f"{end}_city": lookup(key, {r[0]: r[1] for r in C.AIRPORTS}, None, "string"),
                f"{end}_lat": lookup(key, {r[0]: r[2] for r in C.AIRPORTS}, lat),
                f"{end}_lon": lookup(key, {r[0]: r[3] for r in C.AIRPORTS}, lon)})
        else:
            side = coords.select(F.col("airport").alias(f"{end}_iata"), F.col("city").alias(f"{end}_city"),
                                 F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
            df = df.join(side, f"{end}_iata", "left").withColumns({
                f"{end}_lat": F.coalesce(f"{end}_lat", F.lit(lat)),
                f"{end}_lon": F.coalesce(f"{end}_lon", F.lit(lon))})
    return df


def heatmap(facts: DataFrame, sector_index: DataFrame | None = None) -> DataFrame:
    """A map row per sector; ``sector_index`` may add index_value and change_pct."""
    grouped = facts.groupBy("sector", "origin_iata", "destination_iata").agg(F.avg("total_fare").alias("fare"))
    out = attach_coords(grouped).withColumns({
        "average_fare": to_places("fare", 1),
        "intensity_score": to_places(F.least(F.lit(1.0), F.col("fare") / 10000.0), 2),
        "annual_pax_millions": lookup("sector", {r[0]: r[8] for r in C.SECTORS}, None),
        "tier": lookup("sector", C.SECTOR_TIERS, "Trunk", "string"),
    }).drop("fare")
    return out if sector_index is None else out.join(sector_index, "sector", "left")


def undirected_lookup(df: DataFrame, specs: DataFrame, value: str, default) -> DataFrame:
    """Value of the sector, else of its reverse, else the default."""
    ends = F.split(code("sector"), "-")
    there = specs.select(F.col("sector").alias("key"), F.col(value).alias("direct"))
    back = specs.select(F.col("sector").alias("reverse_key"), F.col(value).alias("reversed"))
    keyed = df.withColumns({"key": code("sector"), "reverse_key": F.concat_ws("-", F.get(ends, F.lit(1)), F.get(ends, F.lit(0)))})
    return (keyed.join(there, "key", "left").join(back, "reverse_key", "left")
            .withColumn(value, F.coalesce("direct", "reversed", F.lit(default)))
            .drop("key", "reverse_key", "direct", "reversed"))


def in_basket(df: DataFrame, basket: DataFrame | None = None) -> DataFrame:
    """Rows of the monitored sectors."""
    if basket is None:
        return df.filter(F.col("sector").isin(C.SECTOR_CODES))
    return join_cohort(df, basket.select("sector").distinct(), ["sector"], "left_semi")


def basket_grid(sectors: DataFrame) -> DataFrame:
    """Expected (sector, window, carrier, source): direct plus each agency."""
    direct = {row[0]: row[4] for row in C.CARRIERS}
    grid = sectors.select("sector", F.explode(F.array(*[F.lit(w) for w in C.WINDOWS])).alias("advance_days"))
    grid = grid.withColumn("carrier_code", F.explode(F.array(*[F.lit(c) for c in C.CARRIER_CODES])))
    sources = F.array(lookup("carrier_code", direct, None, "string"), *[F.lit(a) for a in C.AGENCIES])
    return grid.withColumn("source", F.explode(sources))


BASKET_KEY = ["sector", "advance_days", "carrier_code", "source"]


def basket_missing(grid: DataFrame, quotes: DataFrame) -> DataFrame:
    """Expected quotes that were not observed.

    The cells of the grid are numbered, and every map task folds its quotes into a presence
    bitmap of the cells, 4 KB for each 32 768 of them; only bitmaps are shuffled.
    """
    cells = stored(grid.distinct().withColumn("cell", F.row_number().over(Window.orderBy(*BASKET_KEY))), "cells")  # a few hundred a sector
    seen = quotes.select("sector", "advance_days", "carrier_code", source_name("source").alias("source"))
    bits = join_cohort(seen, cells, BASKET_KEY).groupBy(F.bitmap_bucket_number("cell").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("present"))
    place = F.bitmap_bit_position("cell")
    byte = F.conv(F.hex(F.substring("present", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return (cells.withColumn("part", F.bitmap_bucket_number("cell")).join(bits, "part", "left")
            .filter(F.col("present").isNull() | ~held).select(*grid.columns))


def basket_fill(grid: DataFrame, quotes: DataFrame) -> DataFrame:
    """Expected and observed quotes, and the fill rate, per sector."""
    seen = (quotes.select("sector", "advance_days", "carrier_code", source_name("source").alias("source"))
            .distinct().withColumn("seen", F.lit(1)))
    return grid.join(seen, BASKET_KEY, "left").groupBy("sector").agg(
        F.count(F.lit(1)).alias("expected"), F.count("seen").alias("observed"),
        to_places(F.count("seen") * 100.0 / F.count(F.lit(1)), 4).alias("fill_rate_pct"))


def basket_counts(quotes: DataFrame) -> DataFrame:
    """Quotes by sector, window and source with subtotals."""
    return quotes.rollup("sector", "advance_days", "source").agg(
        F.count(F.lit(1)).alias("quotes"), F.grouping_id().alias("level"))


def latest_quotes(df: DataFrame, limit: int = 10, order: Sequence[str] = ("scrape_timestamp", "quote_id")) -> DataFrame:
    """Newest quotes; ``limit`` is 1 to 100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return df.orderBy(*[F.desc(c) for c in order]).limit(limit)


def hhi(shares: DataFrame, keys: Sequence[str], share: str = "share_pct", limit: float = 2500.0) -> DataFrame:
    """Sum of squared percentage shares."""
    return shares.groupBy(*keys).agg(F.sum(F.col(share) * F.col(share)).alias("hhi")).withColumn(
        "is_concentrated", F.col("hhi") > limit)


def quote_shares(facts: DataFrame, keys: Sequence[str] = ("sector",)) -> DataFrame:
    """Percentage share of each carrier in the quotes of a group."""
    counts = facts.groupBy(*keys, "carrier_code").agg(F.count(F.lit(1)).alias("quotes"))
    whole = F.sum("quotes").over(Window.partitionBy(*keys))
    return counts.withColumn("share_pct", F.col("quotes") * 100.0 / whole)


def lockstep_moves(facts: DataFrame, min_jump: float = 1000.0, max_gap: float = 150.0, hours: int = 4,
                   hhi_limit: float = 2500.0) -> DataFrame:
    """D3: two carriers raise by nearly the same amount within a few hours on a concentrated sector.

    Quotes are reduced to one mean fare per (sector, window, carrier, scrape hour); the
    pairing is an equi-join on exploded hour offsets over those, so it is bounded by
    hours × carriers, not by quotes.
    """
    hourly = facts.withColumn("hour", F.date_trunc("hour", "scrape_timestamp")).groupBy(
        "sector", "advance_days", "carrier_code", "hour").agg(F.avg("total_fare").alias("fare"))
    own = Window.partitionBy("sector", "advance_days", "carrier_code").orderBy("hour")
    jumps = hourly.withColumn("jump", F.col("fare") - F.lag("fare").over(own)).filter(F.col("jump") > min_jump)
    jumps = jumps.withColumn("hour_no", (F.unix_timestamp("hour") / 3600).cast("bigint"))
    left = jumps.select("sector", "advance_days", F.col("carrier_code").alias("carrier_a"), F.col("hour").alias("hour_a"),
                        F.col("jump").alias("jump_a"), "hour_no",
                        F.explode(F.sequence(F.lit(-hours), F.lit(hours))).alias("offset"))
    left = left.withColumn("hour_no", F.col("hour_no") + F.col("offset")).drop("offset")
    right = jumps.select("sector", "advance_days", F.col("carrier_code").alias("carrier_b"), F.col("hour").alias("hour_b"),
                         F.col("jump").alias("jump_b"), "hour_no")
    pairs = left.join(right, ["sector", "advance_days", "hour_no"]).filter(
        (F.col("carrier_a") < F.col("carrier_b")) & (F.abs(F.col("jump_a") - F.col("jump_b")) <= max_gap))
    crowded = hhi(quote_shares(facts), ["sector"], limit=hhi_limit).filter("is_concentrated").select("sector", "hhi")
    return pairs.join(crowded, "sector").drop("hour_no")


def volatility(facts: DataFrame, keys: Sequence[str] = ("sector",), fare: str = "total_fare") -> DataFrame:
    """Standard deviation and coefficient of variation."""
    return facts.groupBy(*keys).agg(
        F.stddev_pop(fare).alias("std"), (F.stddev_pop(fare) / F.avg(fare)).alias("cv"), F.count(F.lit(1)).alias("quotes"))


def asof_fuel(quotes: DataFrame, prices: DataFrame, date: str = "scrape_date", keys: Sequence[str] = ()) -> DataFrame:
    """The newest fuel price on or before each quote's date (prices: price_date, price).

    The as-of rule is worked out once per distinct date, on a union of the two date
    lists, and joined back by date: quotes are never sorted into one task.
    """
    dates = quotes.select(*keys, F.col(date).alias("d")).distinct().withColumn("price", F.lit(None).cast("double"))
    known = prices.select(*keys, F.col("price_date").alias("d"), F.col("price").cast("double").alias("price"))
    line = dates.withColumn("asked", F.lit(True)).unionByName(known.withColumn("asked", F.lit(False)))
    order = Window.partitionBy(*keys, "series").orderBy("d", "asked").rowsBetween(Window.unboundedPreceding, 0)
    filled = (line.withColumn("series", F.lit(0))
              .withColumn("fuel_price", F.last("price", ignorenulls=True).over(order))
              .filter("asked").select(*keys, F.col("d").alias(date), "fuel_price"))
    return join_cohort(quotes, filled, [*keys, date], "left")


def fuel_correlation(joined: DataFrame, keys: Sequence[str] = (), fare: str = "fare", fuel: str = "fuel_price") -> DataFrame:
    """D7."""
    return joined.groupBy(*keys).agg(F.corr(fare, fuel).alias("correlation"), F.count(F.lit(1)).alias("points"))
