"""Index formulas: hand values and axioms."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.operators import elementary, multilateral, national, ranking, route
from fareloom.sources import tables

QUOTE = "sector string, carrier_code string, advance_days int, flight_number string, departure_time string, total_fare double, travel_date string, quote_id string"


def quotes(spark, rows):
    return spark.createDataFrame(rows, QUOTE).withColumn("travel_date", F.to_date("travel_date"))


def test_geometric_mean_and_exclusion(spark):
    df = spark.createDataFrame([("a", p) for p in (100.0, 200.0, 400.0, 800.0, -50.0, 0.0)], "k string, fare double")
    row = elementary.geometric_means(df, ["k"]).collect()[0]
    assert math.exp(row.log_mean) == pytest.approx(282.8427, abs=1e-3)
    assert (row.quotes, row.usable) == (6, 4)


def test_matched_pairs_win_over_means(spark):
    base = quotes(spark, [("DEL-BOM", "6E", 7, "6E-1", "08:00", 4500.0, "2024-01-01", "b1"),
                          ("DEL-BOM", "6E", 7, "6E-2", "09:00", 5000.0, "2024-01-01", "b2"),
                          ("DEL-BOM", "6E", 7, "6E-9", "09:00", 0.0, "2024-01-01", "b3")])
    cur = quotes(spark, [("DEL-BOM", "6E", 7, "6e-1 ", "08:00", 4950.0, "2024-02-01", "c1"),
                         ("DEL-BOM", "6E", 7, "6E-2", "09:00", 5500.0, "2024-02-01", "c2"),
                         ("DEL-BOM", "6E", 7, "6E-3", "10:00", 9999.0, "2024-02-01", "c3")])
    row = elementary.jevons_of_two(base, cur).collect()[0]
    assert (row.index_value, row.matched_quote_count, row.base_quote_count) == (1.1, 2, 3)
    unmatched = elementary.jevons_of_two(base, cur, match=False).collect()[0]
    assert unmatched.index_value == pytest.approx((4950 * 5500 * 9999) ** (1 / 3) / (4500 * 5000) ** 0.5, abs=1e-5)


def test_numbers_of_one_flight_with_most_rows(spark):
    rng = random.Random(3)
    rows = [("DEL-BOM", "6E", 7, f"6E-{rng.randrange(2)}", "08:00", float(rng.randrange(2000, 9000)),
             f"2024-01-{1 + rng.randrange(3):02d}", f"{i:05d}") for i in range(200)]
    df = elementary.prepare(quotes(spark, rows), None, extra=["travel_date", "quote_id"])
    keys = [*elementary.COHORT, *elementary.FLIGHT]
    df = df.withColumn("quote_id", F.concat(F.lit("indigo-00000000"), "quote_id"))  # ids of one beginning
    order = Window.partitionBy(*keys).orderBy("travel_date", "quote_id")
    want = df.withColumn("occurrence", F.row_number().over(order))
    got = ranking.occurrence_no(df.repartition(7), keys, "travel_date", "quote_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_numbers_and_pairs_do_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(4)
    rows = [("DEL-BOM", "6E", 7, f"6E-{rng.randrange(3) ** 2}", "08:00", float(rng.randrange(2000, 9000)),
             f"2024-01-{1 + rng.randrange(3):02d}", f"{i:05d}") for i in range(200)]
    df = elementary.prepare(quotes(spark, rows), None, extra=["travel_date", "quote_id"])
    keys = [*elementary.COHORT, *elementary.FLIGHT]
    want = df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy("travel_date", "quote_id")))
    for most_rows in (1_000_000, 90, 0):  # no group, some and all are numbered by stretches
        got = ranking.occurrence_no(df, keys, "travel_date", "quote_id", near=keys[:4], most_rows=most_rows)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lagged_indices_shuffle_the_rows_once(spark):
    rows = [("DEL-BOM", "6E", 7, "6E-1", "08:00", 4000.0 + i, f"2024-01-{i + 1:02d}", str(i)) for i in range(20)]
    found = elementary.elementary_indices_lagged(quotes(spark, rows), 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # of the rows, of the sums by date, and of those by cohort
    assert plan.count("Exchange hashpartitioning") == 3
    assert found.count() == 13


def test_time_reversal(spark):
    rng = random.Random(5)
    rows = [[("DEL-BOM", "AI", 1, f"AI-{i}", "08:00", rng.uniform(2000, 9000), "2024-01-01", f"{s}{i}") for i in range(n)]
            for s, n in (("a", 40), ("b", 55))]
    a, b = quotes(spark, rows[0]), quotes(spark, rows[1])
    there = elementary.jevons_of_two(a, b).collect()[0].index_value
    back = elementary.jevons_of_two(b, a).collect()[0].index_value
    assert there * back == pytest.approx(1.0, abs=2e-6)


def elem(spark, rows):
    return spark.createDataFrame(rows, "sector string, advance_days int, carrier_code string, index_value double")


def test_route_weights_are_renormalised(spark):
    cells = elem(spark, [("DEL-BOM", 7, "6E", 1.10), ("DEL-BOM", 7, "AI", 1.05), ("BOM-DEL", 7, "SG", 1.2345)])
    out = {r.sector: r for r in route.route_indices(cells, shares_base={"6E": 0.6, "AI": 0.3, "IX": 0.1},
                                                    shares_current={"6E": 0.5, "AI": 0.2, "IX": 0.3}).collect()}
    w = 0.5 * (0.6 / 0.9 + 0.5 / 0.7)
    assert out["DEL-BOM"].index_value == pytest.approx(math.exp(w * math.log(1.1) + (1 - w) * math.log(1.05)), abs=1e-6)
    assert out["DEL-BOM"].missing_carriers == ["IX", "QP", "SG"]
    assert (out["BOM-DEL"].index_value, out["BOM-DEL"].is_monopoly) == (1.2345, True)


def test_national_index_complete_and_partial(spark):
    omega = national.default_omega(spark)
    check = national.check_omega(omega).collect()[0]
    assert (check.cells, check.is_normalised) == (150, True)
    whole = omega.select("sector", "advance_days", F.lit(1.10).alias("index_value"))
    row = national.national_laspeyres(whole, omega).collect()[0]
    assert (row.composite_index, row.is_fully_observed, row.missing_cells_count) == (110.0, True, 0)
    one = whole.filter("sector = 'DEL-BOM' and advance_days = 7").withColumn("index_value", F.lit(1.15))
    part = national.national_laspeyres(one, omega).collect()[0]
    assert (part.composite_index, part.missing_cells_count) == (115.0, 149)
    filled = national.national_laspeyres(one, omega, impute=False, fallback=1.0).collect()[0]
    assert 100.0 < filled.composite_index < 115.0
    assert national.missing_cells(one, omega).count() == 149


def test_contributions_add_up(spark):
    omega = national.default_omega(spark)
    cells = omega.select("sector", "advance_days", (F.lit(1.0) + F.col("omega")).alias("index_value"))
    rows = national.contributions(cells, omega).collect()
    total = [r.contribution for r in rows if r.dimension == "all"][0]
    for dimension in ("sector", "window", "tier"):
        assert sum(r.contribution for r in rows if r.dimension == dimension) == pytest.approx(total, abs=1e-4)
    trunk = [r for r in rows if r.member == "Trunk"][0]
    assert trunk.observed_weight == pytest.approx(0.5388889, abs=1e-7)


def brute_series(levels, length, method):
    out = []
    for t in range(len(levels)):
        first = max(0, t - length + 1)
        g = [x / levels[first] for x in levels[first:t + 1]]
        if t == 0:
            out.append(100.0)
            continue
        past = out[first:t]
        move, wide = past[-1] * g[-1] / g[-2], past[0] * g[-1] / g[0]
        mean = g[-1] * math.exp(sum(math.log(p / x) for p, x in zip(past, g)) / len(past))
        value = {"mean": mean, "movement": move, "window": wide, "half": math.sqrt(move * wide)}[method]
        out.append(round(value, 4))
    return out


@pytest.mark.parametrize("method", multilateral.SPLICES)
def test_rolling_series_against_brute_force(spark, method):
    rng = random.Random(11)
    levels = [round(rng.uniform(80, 130), 4) for _ in range(20)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(levels)], "series_id string, period int, level double")
    rows = multilateral.rygeks_series(df, length=5, method=method).orderBy("period").collect()
    assert [r.published_index for r in rows] == pytest.approx(brute_series(levels, 5, method), abs=2e-4)
    assert [r.is_expanding_window for r in rows] == [i + 1 < 5 for i in range(20)]


def test_published_values_are_never_revised(spark):
    rows = [("s", i, 100.0 + 7 * math.sin(i)) for i in range(12)]
    schema = "series_id string, period int, level double"
    short = multilateral.rygeks_series(spark.createDataFrame(rows[:8], schema), length=4).orderBy("period").collect()
    long = multilateral.rygeks_series(spark.createDataFrame(rows, schema), length=4).orderBy("period").collect()
    assert [r.published_index for r in short] == [r.published_index for r in long[:8]]


def test_pairwise_relatives_with_a_gap(spark):
    periods = spark.createDataFrame([("s", i) for i in range(3)], "series_id string, period int")
    pairs = spark.createDataFrame([("s", 0, 1, 1.02), ("s", 1, 2, 1.01)], "series_id string, p_from int, p_to int, rel double")
    rows = multilateral.rygeks_series(pairwise=pairs, periods=periods, length=4).orderBy("period").collect()
    assert rows[1].published_index == 102.0
    # 0 -> 2 is missing, so it goes through period 0 itself and counts as 1
    assert rows[2].window_length == 3


def test_geks_has_no_chain_drift(spark):
    rng = random.Random(2)
    base = [2500.0, 4200.0, 6100.0]
    prices = [base] + [[p * rng.uniform(0.75, 1.35) for p in base] for _ in range(5)] + [base]
    weights = [[1 / 3] * 3] + [[w / 10 for w in rng.choice([(2, 3, 5), (6, 1, 3), (4, 4, 2)])] for _ in range(5)] + [[1 / 3] * 3]
    rows = []
    for i in range(7):
        for j in range(7):
            log = sum(0.5 * (weights[i][k] + weights[j][k]) * math.log(prices[j][k] / prices[i][k]) for k in range(3))
            rows.append(("s", i, j, i, j, math.exp(log)))
    df = spark.createDataFrame(rows, "series_id string, p_from int, p_to int, i int, j int, rel double")
    found = multilateral.chain_drift(df).collect()[0]
    assert found.geks == pytest.approx(1.0, abs=1e-9)
    assert abs(found.drift) > 1e-4
    vector = {r.period: r.geks for r in multilateral.geks_vector(df).collect()}
    assert vector[0] == 1.0 and vector[6] == pytest.approx(1.0, abs=1e-9)


def test_published_check_values(spark):
    """The year values stated for the region view at sf0.01."""
    import os
    from fareloom.plans import catalog
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no sf0.01 tables")
    got = {r.year: r.composite_index for r in catalog.national_index_by_year(spark, folder).collect()}
    assert got == {1995: 100.0, 1996: 109.0958, 1997: 105.4473, 1998: 110.9501, 1999: 116.3776, 2000: 110.7592, 2001: 106.8204}
    assert set(C.WINDOWS) == {1, 7, 15, 30, 45} and tables.SECTOR_RING[-1] == "NAG-BOM"
