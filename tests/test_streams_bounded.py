"""Streams whose state does not grow, and plans and folds that hold for long input."""

import math
import time

import pytest
from pyspark.sql import functions as F

from fareloom.operators import analytics, multilateral, screening
from fareloom.sources import tables
from fareloom.streaming import flows


def test_first_sights_in_shuffled_order_with_flat_state(spark, tmp_path):
    """Ids that come again long after they left the state are told; each comes out once."""
    folder, n = str(tmp_path / "in"), 6
    schema = "id string, payload int"
    checkpoint, out = str(tmp_path / "ck"), str(tmp_path / "out")
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    sizes, ids = [], []
    for k in range(n):
        batch = [f"new-{k}-{i}" for i in range(50)] + ["always"] * 3 + ids[::7]
        ids += batch[:50]
        spark.createDataFrame([(x, k) for x in batch], schema).repartition(2).write.mode("append").parquet(folder)
        got = flows.run_first_sights(flows.stream_dedup(stream, "id", keep="1 second"), out, checkpoint, "id")
        time.sleep(1.2)
        state = spark.read.format("statestore").load(checkpoint)
        sizes.append(state.count())
    found = [r.id for r in got.collect()]
    assert sorted(found) == sorted({*ids, "always"}) and got.columns == ["id", "payload"]
    assert max(sizes) < 3 * 60  # of over 300 ids


def test_a_batch_of_first_sights_that_runs_again(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ("ab", "bc", "cad"):
        spark.createDataFrame([(x,) for x in ids], "id string").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(folder)
    for checkpoint in ("ck", "lost"):  # the second time, the same batches run again
        got = flows.run_first_sights(stream, out, str(tmp_path / checkpoint), "id")
        assert sorted(r.id for r in got.collect()) == ["a", "b", "c", "d"]


def test_moments_of_parts_are_those_of_the_whole(spark, sample):
    facts = tables.facts(spark, sample).withColumn("total_fare", F.col("total_fare") + 1e7)
    parts = [flows.trunk_moments(facts.filter(F.pmod(F.xxhash64("quote_id"), F.lit(3)) == k)) for k in range(3)]
    merged = flows.merged_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    key = lambda r: (r.window.start, r.sector, r.advance_days)
    got, want = (sorted(df.collect(), key=key) for df in (merged, flows.trunk_moments(facts)))
    assert [key(r) + (r.quotes,) for r in got] == [key(r) + (r.quotes,) for r in want] and got
    assert [r.mean_fare for r in got] == pytest.approx([r.mean_fare for r in want], rel=1e-12)
    assert [r.m2 for r in got] == pytest.approx([r.m2 for r in want], rel=1e-6, abs=1e-3)


def plain_splice(vectors, method):
    out = []
    for g in vectors:
        if not out:
            out.append(100.0)
            continue
        n = len(g)
        history = out[-(n - 1):]
        if method == "mean":
            value = g[-1] * math.exp(sum(math.log(p) - math.log(x) for p, x in zip(history, g)) / (n - 1))
        else:
            movement, oldest = history[-1] * g[-1] / g[-2], history[0] * g[-1] / g[0]
            value = {"movement": movement, "window": oldest, "half": math.sqrt(movement * oldest)}[method]
        out.append(math.floor(value * 1e4 + 0.5 + 1e-7) / 1e4)
    return out


@pytest.mark.parametrize("method", multilateral.SPLICES)
def test_long_series_are_spliced_block_by_block(spark, method):
    vectors = [[1.0 + ((t * 7 + k * 3) % 11) / 100 for k in range(min(t + 1, 5))] for t in range(2 * multilateral.BLOCK + 37)]
    df = spark.createDataFrame([("s", t, g) for t, g in enumerate(vectors)], "series_id string, t int, g array<double>")
    rows = sorted(multilateral.splice(df.repartition(3), method).collect(), key=lambda r: r.t)
    assert [r.t for r in rows] == list(range(len(vectors)))
    assert [r.published for r in rows] == pytest.approx(plain_splice(vectors, method), abs=2e-4)
    assert [r.window_length for r in rows] == list(map(len, vectors))


def test_anomalies_read_the_quotes_for_the_flags_only(spark, sample):
    quotes = tables.facts(spark, sample).select("quote_id", "sector", "advance_days", "total_fare")
    plan = screening.mad_anomalies(quotes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [") == plan.count("parquet") and plan.count("l_extendedprice") < 60
    assert sum("l_orderkey" in line for line in plan.splitlines() if "Relation [" in line) == 1


def test_missing_cells_shuffle_bitmaps_only(spark):
    grid = analytics.basket_grid(spark.createDataFrame([(f"S{i:03d}",) for i in range(300)], "sector string"))
    cells = grid.distinct().orderBy(*analytics.BASKET_KEY).collect()
    assert len(cells) > 32768  # more than one bitmap
    seen = [c for k, c in enumerate(cells) if k % 3 or k > 40000]
    quotes = spark.createDataFrame(seen * 2, grid.schema)
    missing = analytics.basket_missing(grid, quotes)
    assert sorted(map(tuple, missing.collect())) == sorted(set(map(tuple, cells)) - set(map(tuple, seen)))
    assert analytics.basket_missing(grid, quotes.limit(0)).count() == len(cells)
    plan = missing._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan"):]
    assert "partial_bitmap_construct_agg" in initial and "BroadcastHashJoin [sector" in initial
    assert "Exchange" not in initial[initial.index("partial_bitmap_construct_agg"):initial.index("BroadcastHashJoin [sector")]
