"""Cleaning rules: boundary tables, hand values, skew-proof ranks against brute force."""

import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fareloom.functions import text
from fareloom.operators import analytics, decompose, dedup, normalize, quality, ranking, screening, tagging

RAW = ("quote_id string, source string, origin string, destination string, carrier string, flight_number string, departure_time string, "
       "arrival_time string, travel_date string, advance_days int, duration_minutes int, total_fare double, seats_available int, scrape_date string")


def raw(spark, fares, source="indigo", flight=None, seats=5):
    rows = [(f"q{i:04d}", source, "del", "BOM ", "6e", flight or f"6E-{i}", "08:00", "10:00", "2024-03-04", 7, 120, float(f), seats, "2024-02-26 06:00:00")
            for i, f in enumerate(fares)]
    return normalize.normalize_quotes(spark.createDataFrame(rows, RAW))


def test_normalize_and_validate(spark):
    row = raw(spark, [4500]).collect()[0]
    assert (row.origin_iata, row.destination_iata, row.carrier_code, row.raw_total_fare) == ("DEL", "BOM", "6E", Decimal("4500.00"))
    assert str(row.scrape_timestamp) == "2024-02-26 06:00:00"
    bad = raw(spark, [1]).withColumns({"destination_iata": F.lit("DEL"), "duration_minutes": F.lit(0), "seats_available": F.lit(-1)})
    valid, rejected = normalize.validate_quotes(bad)
    assert valid.count() == 0
    assert rejected.collect()[0].violations == ["same_airport", "bad_duration", "negative_seats"]


@pytest.mark.parametrize("fare,low,high", [(998.99, True, False), (999.0, False, False), (25000.0, False, False), (25000.01, False, True)])
def test_fare_limits(spark, fare, low, high):
    row = spark.range(1).select(quality.is_floor_violation(F.lit(fare)), quality.is_ceiling_violation(F.lit(fare))).collect()[0]
    assert tuple(row) == (low, high)


def test_surge_and_variance_limits(spark):
    surge = [quality.is_temporal_surge(F.lit(3000.0), F.lit(3000.0 * m)) for m in (3.999, 4.0, 4.001)]
    odd = [quality.is_cross_source_variance(F.lit(4000.0 * m), F.lit(4000.0)) for m in (1.5, 1.501, 0.5, 0.499)]
    assert tuple(spark.range(1).select(*surge, *odd).collect()[0]) == (False, False, True, False, True, False, True)


@pytest.mark.parametrize("fares,low,high", [([4500] * 50, 3825, 5175), ([1000] * 30, 999, 1150), ([24000] * 30, 20400, 25000)])
def test_flat_cohorts(spark, fares, low, high):
    stats = quality.cohort_stats(quality.with_cohort(raw(spark, fares))).collect()[0]
    assert (stats.lower_bound, stats.upper_bound) == (pytest.approx(low), pytest.approx(high))


def test_batch_cleaning_keeps_52(spark):
    batch = raw(spark, [4500] * 50 + [4545, 4410, 22500, 200, 90000])
    clean = quality.clean_quotes_batch(batch).cache()
    assert quality.clean_quotes(clean).count() == 52
    flags = {float(r.total_fare): r for r in clean.filter("is_outlier").collect()}
    assert flags[200.0].outlier_reason == "DOMAIN_FLOOR" and flags[200.0].is_quarantined
    assert flags[90000.0].outlier_reason == "DOMAIN_CEILING"
    assert flags[22500.0].flags == ["STATISTICAL_IQR", "CROSS_SOURCE_VARIANCE"] and flags[22500.0].data_quality_score < 80


def test_parts_always_sum_to_the_total(spark):
    rng = random.Random(4)
    fares = [round(rng.uniform(500, 30000), 2) for _ in range(300)] + [0.0, 999.0, 1000.0, 1180.0, 1240.5]
    parts = decompose.decompose_fare(raw(spark, fares)).collect()
    for r in parts:
        assert r.base_fare + r.fuel_surcharge + r.airport_taxes_gst + r.user_dev_fee + r.passenger_service_fee + r.convenience_fee == r.total_fare
        assert r.total_fare < 999 or r.base_fare >= 0
    typical = decompose.decompose_fare(raw(spark, [5000.0])).collect()[0]
    taxable = (5000 - 650 - 180) / 1.05
    assert float(typical.fuel_surcharge) == pytest.approx(taxable * 0.25, abs=0.01)


def test_sold_out(spark):
    rows = normalize.handle_sold_out(raw(spark, [0, 5200], seats=0)).orderBy("quote_id").collect()
    assert [float(r.raw_total_fare) for r in rows] == [16500.0, 5200.0] and all(r.is_sold_out for r in rows)


def test_direct_source_beats_cheaper_agency(spark):
    both = raw(spark, [5500], flight="6E-1").union(raw(spark, [5100, 4950], "makemytrip", flight="6e 1"))
    assert [r.source for r in dedup.deduplicate_quotes(both).collect()] == ["indigo"]
    agencies = raw(spark, [5100, 5250, 4950], "ixigo", flight="6E-1")
    assert float(dedup.deduplicate_quotes(agencies).collect()[0].raw_total_fare) == 4950.0


def test_exact_quantiles_and_ranks_with_a_hot_group(spark):
    rng = random.Random(8)
    data = [("hot", round(rng.lognormvariate(8, 1), 2)) for _ in range(3000)] + [("hot", 4000.0)] * 2000
    data += [("flat", 7.0)] * 9 + [("few", -5.0), ("few", 1.5), ("few", 3.25), ("one", 2.0)]
    df = spark.createDataFrame(data, "k string, x double")
    groups = {}
    for k, x in data:
        groups.setdefault(k, []).append(x)
    probs = {"q1": 0.25, "md": 0.5, "q9": 0.9}
    for row in ranking.exact_quantiles(df, ["k"], "x", probs).collect():
        want = np.percentile(groups[row.k], [25, 50, 90])
        assert (row.n, [row.q1, row.md, row.q9]) == (len(groups[row.k]), pytest.approx(list(want)))
    ranks = {(r.k, r.x): r["rank"] for r in ranking.value_ranks(df, ["k"], "x").collect()}
    for k, values in groups.items():
        ordered = sorted(values)
        assert all(ranks[k, x] == ordered.index(x) + 1 for x in set(values))


def test_anomalies(spark):
    fares = [4900.0, 5000.0, 5100.0, 4950.0, 5050.0, 5020.0, 18500.0]
    df = spark.createDataFrame([("DEL-BOM", 7, f"q{i}", f) for i, f in enumerate(fares)], "sector string, advance_days int, quote_id string, total_fare double")
    found = screening.mad_anomalies(df).collect()
    assert [(r.observed_fare, r.severity, r.anomaly_type) for r in found] == [(18500.0, "critical", "price_surge")]
    mad = statistics.median(abs(f - statistics.median(fares)) for f in fares)
    assert found[0].z_score == pytest.approx(0.6745 * (18500 - 5020) / mad, abs=0.01)


def test_kendall(spark):
    ranks = [[1, 2, 3, 4, 5], [1, 2, 3, 5, 4], [2, 1, 3, 4, 5], [1, 2, 4, 3, 5]]
    df = spark.createDataFrame([(f"s{i}", f"f{j}", r) for i, row in enumerate(ranks) for j, r in enumerate(row)], "source string, item string, rank int")
    assert 0.8 <= screening.kendall_w(df).collect()[0].kendall_w <= 1.0


def test_scenario_and_affordability(spark):
    row = analytics.scenario_projection(spark.createDataFrame([(15.0, 5.0)], "atf_change_pct double, demand_shock_pct double"), F.lit(134.72)).collect()[0]
    assert row.delta_pct == 9.05 and row.projected_index == pytest.approx(134.72 * 1.0905, abs=0.01)
    fair = analytics.affordability(spark.createDataFrame([("DEL", "BOM", 5120.0)], "origin_iata string, destination_iata string, average_fare double")).collect()[0]
    assert fair.wage_days_required == 4.5 and fair.affordability_rating == "Affordable"
    with pytest.raises(ValueError):
        analytics.search_fares(raw(spark, [1]), "DEL", "BOM", 10, 5)


def test_window_keys_and_tags(spark):
    labels = spark.createDataFrame([("T+7",), ("t_15",), (" 45 ",), ("T+8",), ("soon",)], "w string")
    assert [r[0] for r in labels.select(text.window_days("w")).collect()] == [7, 15, 45, None, None]
    asked = spark.createDataFrame([("Show DEL-BOM fares by IndiGo for 7 days",), ("What if fuel shock hits Goa and Pune",), ("hello",)], "text string")
    rows = tagging.tag_queries(asked).collect()
    assert (rows[0].sector, rows[0].carrier_code, rows[0].advance_window, rows[0].intent) == ("DEL-BOM", "6E", 7, "carrier_comparison")
    assert (rows[1].origin, rows[1].destination, rows[1].intent) == ("PNQ", "GOI", "simulation")
    assert rows[2].intent == "general_overview"


def test_earlier_fare_in_one_shuffle(spark):
    rows = [(f, d, q, t, fare) for f, d, q, t, fare in (
        ("6E-1", "2024-03-01", "a", "2024-02-01 08:00:00", 4000.0), ("6E-1", "2024-03-01", "b", "2024-02-01 09:00:00", 4100.0),
        ("6E1", "2024-03-01", "c", "2024-02-03 07:00:00", 5000.0), ("6E-1", "2024-03-01", "d", "2024-02-03 07:00:00", 5100.0),
        ("6E-1", "2024-03-01", "e", "2024-02-04 07:00:00", 6000.0), ("6E-1", None, "f", "2024-02-04 07:00:00", 1.0),
        ("6E-1", None, "g", "2024-02-05 07:00:00", 2.0), ("6E-2", "2024-03-01", "h", None, 3.0), ("6E-2", "2024-03-01", "i", "2024-02-04 07:00:00", None))]
    df = spark.createDataFrame(rows, "flight_number string, travel_date string, quote_id string, scrape_timestamp string, raw_total_fare double")
    df = df.select("flight_number", F.to_date("travel_date").alias("travel_date"), "quote_id", F.to_timestamp("scrape_timestamp").alias("scrape_timestamp"),
                   "raw_total_fare", *[F.lit(v).alias(c) for c, v in (("origin_iata", "DEL"), ("destination_iata", "BOM"), ("carrier_code", "6E"), ("source", "indigo"))])
    found = dedup.previous_day_fare(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.quote_id: r.prev_fare for r in found.collect()} == {
        "a": None, "b": None, "c": 4100.0, "d": 4100.0, "e": 5100.0, "f": None, "g": None, "h": None, "i": 3.0}


def test_search_patterns_find_what_their_definitions_find(spark):
    rng = random.Random(6)
    parts = ["del", "bom", "goa", "to", "-", "/", " ", " ", "t+", "7", "15", "day", "days", "air india", "ai", "ix", "mumbai", "_", "é", "\n", ",", "x9", "air  india"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    pair = F.regexp_extract("q", tagging.SECTOR_FOUND, 0)
    got = df.select("q", F.left(pair, F.lit(3)).alias("o"), F.right(pair, F.lit(3)).alias("d"), F.regexp_extract("q", tagging.WINDOW_FOUND, 1).alias("w"),
                    *[tagging.has_word(F.col("q"), w).alias(f"w{i}") for i, w in enumerate(("ai", "air india", "ix", "goa", "mumbai"))],
                    *[F.regexp_extract("q", tagging.SECTOR, i).alias(f"x{i}") for i in (1, 2)], F.regexp_extract("q", tagging.WINDOW, 1).alias("xw"),
                    *[F.col("q").rlike(tagging.BEFORE + w + tagging.AFTER).alias(f"x_w{i}") for i, w in enumerate(("ai", "air india", "ix", "goa", "mumbai"))])
    for r in got.collect():
        assert (r.o, r.d, r.w) == (r.x1, r.x2, r.xw), r
        assert [r[f"w{i}"] for i in range(5)] == [r[f"x_w{i}"] for i in range(5)], r
    plan = tagging.tag_queries(df, "q")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 3 and "lambdafunction" not in plan  # one for a pair, two for the window
