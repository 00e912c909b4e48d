"""The side tables of a store: kept in step, read in part, and whole after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from fareloom.operators import quality
from fareloom.sources import ledger, quotes, tables, weights
from fareloom.streaming import flows


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(ledger, "BUCKETS", 8)
    monkeypatch.setattr(ledger, "SHARDS", 4)


def some_facts(spark, sample, condition="l_orderkey % 3 = 0"):
    lines = tables.table(spark, sample, "lineitem").filter(condition)
    return quality.stored_form(weights.attach_dims(tables.facts_of(lines))).dropDuplicates(["quote_id"])


def in_step(spark, store):
    """The side tables as they are, and as the store's rows ask for."""
    book, rows = quotes.open_store(spark, store), quotes.read_store(spark, store)
    ids = sorted(map(tuple, book.months_of(rows).collect()))
    fares = sorted(map(tuple, book.fares_of(rows.withColumn("weekday", F.weekday("travel_date"))).collect()))
    assert ids == sorted(map(tuple, rows.select("quote_id", "travel_month").collect()))
    assert fares == sorted(map(tuple, ledger.cohort_fares(rows).collect()))
    whole = ledger.summed([book._changes("fares").select(*ledger.COHORT, "fare", "n")], [*ledger.COHORT, "fare"])
    assert sorted(map(tuple, whole.collect())) == fares
    return len(ids)


def test_side_tables_follow_the_store(spark, sample, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "MOST_FOLDERS", 2)
    store, facts = str(tmp_path / "store"), some_facts(spark, sample).cache()
    for k in range(2):  # new rows
        quotes.merge_store(spark, store, facts.filter(F.pmod(F.xxhash64("quote_id"), F.lit(2)) == k))
    assert in_step(spark, store) == facts.count()
    moved = facts.filter("sector = 'DEL-BOM'").withColumns({"travel_date": F.add_months("travel_date", 7), "total_fare": F.lit(1234.0)})
    quotes.merge_store(spark, store, moved)
    assert in_step(spark, store) == facts.count()
    quotes.merge_store(spark, store, facts.withColumn("quote_id", F.concat("quote_id", F.lit("-again"))), per_flight=True)
    in_step(spark, store)
    quotes.write_store(facts.withColumn("total_fare", F.lit(77.0)), store)  # past the ledger
    in_step(spark, store)


@pytest.mark.parametrize("step", ["months", "fares"])
def test_a_failed_merge_leaves_store_and_side_tables_whole(spark, sample, tmp_path, monkeypatch, step):
    store, facts = str(tmp_path / "store"), some_facts(spark, sample).cache()
    first, second = facts.filter("sector <> 'DEL-BOM'"), facts.withColumn("total_fare", F.col("total_fare") + 1)
    quotes.merge_store(spark, store, first)

    def fails(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        if step == "months":  # after the merge was ready
            broken.setattr(quotes, "_write_months", fails)
        else:  # before
            write = ledger.Ledger._write
            broken.setattr(ledger.Ledger, "_write", lambda self, name, *a: fails() if name == "fares" else write(self, name, *a))
        with pytest.raises(OSError):
            quotes.merge_store(spark, store, second)
    n = in_step(spark, store)
    assert n == (facts.count() if step == "months" else first.count())
    quotes.merge_store(spark, store, second)  # the batch comes again
    assert in_step(spark, store) == facts.count()
    assert quotes.read_store(spark, store).select("quote_id", "total_fare").exceptAll(second.select("quote_id", "total_fare")).isEmpty()


def test_a_merge_reads_its_buckets_shards_and_months(spark, sample, tmp_path):
    store, facts = str(tmp_path / "store"), some_facts(spark, sample).cache()
    quotes.merge_store(spark, store, facts)
    few = facts.limit(2).withColumn("weekday", F.weekday("travel_date")).cache()
    book = quotes.open_store(spark, store)
    for df, folder in ((book.months_of(few), "bucket="), (book.fares_of(few), "shard=")):
        read = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in read and folder.strip("=") + "#" in read
    months = [r[0] for r in few.select(F.date_format("travel_date", "yyyy-MM")).distinct().collect()]
    kept = quotes.store_months(spark, store, months)
    files = {m.split("/")[0] for f in kept.filter("true").select(F.input_file_name()).distinct().collect() for m in [f[0].split("travel_month=")[1]]}
    assert files == set(months)


def test_upserts_agree_over_one_four_and_twenty_batches(spark, sample, tmp_path):
    lines = tables.table(spark, sample, "lineitem").filter("l_orderkey % 8 = 0")
    got = {}
    for n in (1, 4, 20) if os.environ.get("FARELOOM_ALL") else (1, 4):
        folder, store = str(tmp_path / f"in{n}"), str(tmp_path / f"store{n}")
        lines.repartition(n, F.rand(n)).write.parquet(f"{folder}/lineitem.parquet")
        flows.run_batches(tables.raw_quotes_of(flows.table_stream(spark, folder, "lineitem", 1)), flows.upsert_batches(store), str(tmp_path / f"ck{n}"))
        rows = quotes.read_store(spark, store)
        got[n] = sorted(map(tuple, rows.select("quote_id", "total_fare").collect()))
        in_step(spark, store)
    assert all(rows == got[1] for rows in got.values()) and got[1]


def test_a_first_merge_folds_and_shuffles_no_more_than_it_must(spark, sample, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "LEAST_FOLD", 10)
    folds, settles = [], []
    fold, first = ledger.Ledger._fold, quotes.deduplicate_quotes
    monkeypatch.setattr(ledger.Ledger, "_fold", lambda self: (folds.append(self.last.merge), fold(self)))
    monkeypatch.setattr(quotes, "deduplicate_quotes", lambda rows, *a: settles.append(rows.count()) or first(rows, *a))
    store, facts = str(tmp_path / "store"), quotes.one_per_flight(some_facts(spark, sample)).cache()
    settles.clear()
    quotes.merge_store(spark, store, facts, per_flight=True)
    assert folds == [] and settles == []  # before, a lone folder was folded and all rows went through both windows
    assert in_step(spark, store) == facts.count()
    # the same flights under other ids for two of them: only those rows meet
    twice = facts.orderBy("quote_id").limit(2).withColumns({"quote_id": F.concat("quote_id", F.lit("-low")), "total_fare": F.col("total_fare") - 1})
    quotes.merge_store(spark, store, twice.unionByName(twice), per_flight=True)
    assert settles == [4] and in_step(spark, store) == facts.count()


@pytest.mark.parametrize("most", [0, 1, 100_000])
def test_settling_only_repeated_keys_equals_settling_all(spark, monkeypatch, most):
    from fareloom.operators import dedup
    monkeypatch.setattr(dedup, "MAX_BROADCAST_ROWS", most)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3), (None, 4), ("c", None)], "k string, v int")
    least = lambda df: df.groupBy("k").agg(F.min("v").alias("v"))
    got = dedup.settled(rows, ["k"], least).collect()
    assert sorted(map(str, got)) == sorted(map(str, least(rows).collect()))


def test_quantiles_of_unfolded_signed_counts_equal_folded_ones(spark):
    from fareloom.operators.ranking import quantiles_of_counts
    rows = [("x", float(v % 17), 1) for v in range(60)] + [("x", 3.0, -1), ("x", 500.0, 2), ("x", 500.0, -2), ("y", 1.0, 1), ("y", 1.0, -1), (None, 2.0, 1)]
    rows += [("z", float(-v * v), 3) for v in range(9)]
    parts = spark.createDataFrame(rows, "k string, v double, n long").repartition(3)
    probs = {"low": 0.25, "mid": 0.5, "high": 0.75}
    want = quantiles_of_counts(ledger.summed([parts], ["k", "v"]), ["k"], "v", probs).collect()
    assert sorted(quantiles_of_counts(parts, ["k"], "v", probs, folded=False).collect()) == sorted(want) and len(want) == 2


def test_dealing_quotes_first_keeps_the_same_quotes_and_sorts_no_map_task(spark, sample):
    from fareloom.operators import dedup
    valid = tables.valid_quotes(spark, sample)
    want = sorted(map(tuple, dedup.deduplicate_quotes(valid).select("quote_id", "source").collect()))
    for most in (0, 10, 1_000_000):
        got = dedup.deduplicate_quotes(valid, deal_first=True, most_rows=most).select("quote_id", "source")
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan.split("Initial Plan")[-1].split("Exchange")[1]
