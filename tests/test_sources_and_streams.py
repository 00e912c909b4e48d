"""Readers, sinks, page extraction and the streaming flow."""

import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from fareloom.operators import multilateral, normalize, quality
from fareloom.sources import cpi, pages, quotes, tables, weights
from fareloom.streaming import flows

DOC = {
    "sectors": {f"A{chr(65 + i)}{chr(65 + j)}-ZZ{chr(65 + i)}": {"weight": 1.0 + i, "route_tier": "Trunk"} for i in range(6) for j in range(5)},
    "carrier_market_shares": {"6e": {"market_share": 0.6}, "AI": 0.4},
}
BOOKING = {"distribution": {"T+1": 1, "T_7": 1, "15": 2}, "days_distribution": {"1": 0.05, "7": 0.2, "15": 0.3, "30": 0.3, "45": 0.15}}


def test_weight_files(spark, tmp_path):
    path, booking = tmp_path / "w.json", tmp_path / "b.json"
    path.write_text(json.dumps(DOC, indent=1))
    booking.write_text(json.dumps(BOOKING, indent=1))
    sectors = weights.read_sector_weights(spark, str(path)).collect()
    assert len(sectors) == 30 and sum(r.weight for r in sectors) == pytest.approx(1.0)
    windows = {r.advance_days: r.weight for r in weights.read_window_weights(spark, str(booking)).collect()}
    assert windows == pytest.approx({1: 0.05, 7: 0.2, 15: 0.3, 30: 0.3, 45: 0.15})
    assert {r.carrier_code: r.market_share for r in weights.read_carrier_shares(spark, str(path)).collect()} == {"6E": 0.6, "AI": 0.4}
    assert weights.read_carrier_shares(spark, str(booking)).count() == 6
    path.write_text(json.dumps({"sectors": {"DEL-BOM": {"weight": 1}}}))
    with pytest.raises(Exception, match="expected 30 sectors"):
        weights.read_sector_weights(spark, str(path)).collect()


def some_lines(spark, sample, condition="l_orderkey % 3 = 0"):
    return tables.table(spark, sample, "lineitem").filter(condition)


def test_quote_files_round_trip(spark, sample, tmp_path):
    raw = normalize.normalize_quotes(tables.raw_quotes_of(some_lines(spark, sample)))
    quotes.write_quotes(raw, str(tmp_path / "q"))
    back = quotes.read_quotes(spark, str(tmp_path / "q"), multi_line=False)
    assert back.exceptAll(raw).isEmpty() and raw.exceptAll(back).isEmpty()
    array = tmp_path / "array.json"
    array.write_text(json.dumps([{"origin": "del", "destination": "BOM", "carrier": "6e", "total_fare": "4500.5", "departure_datetime": "2024-03-01T06:30:00"}]))
    row = quotes.read_quotes(spark, str(array)).collect()[0]
    assert (row.origin_iata, float(row.raw_total_fare), row.departure_time, str(row.travel_date)) == ("DEL", 4500.5, "06:30", "2024-03-01")


def test_store_upsert_is_idempotent_and_moves_months(spark, sample, tmp_path):
    store = str(tmp_path / "store")
    facts = quality.stored_form(weights.attach_dims(tables.facts_of(some_lines(spark, sample)))).dropDuplicates(["quote_id"]).cache()
    quotes.write_store(facts, store)
    before = facts.count()
    quotes.merge_store(spark, store, facts)
    assert quotes.read_store(spark, store).count() == before
    # the same ids a month later, with another fare: rows move, none is lost or doubled
    batch = facts.filter("sector = 'DEL-BOM'").withColumns({"travel_date": F.add_months("travel_date", 1), "total_fare": F.lit(1234.0)})
    moved = batch.count()
    quotes.merge_store(spark, store, batch)
    after = quotes.read_store(spark, store)
    assert after.count() == before and after.filter("total_fare = 1234.0").count() == moved > 0
    assert "PartitionFilters: [isnotnull(travel_month" in after.filter("travel_month = '1996-01'")._jdf.queryExecution().toString()


def test_exports_and_cpi_append(spark, tmp_path):
    top = spark.createDataFrame([("2024-07-01", 104.256)], "date string, value double")
    rest = spark.createDataFrame([("2024-07-01", "DEL-BOM", "Trunk", 103.0)], "date string, sector string, route_tier string, value double")
    rows = quotes.export_rows(top, rest)
    quotes.export_csv(rows, str(tmp_path / "csv"))
    with open(glob.glob(f"{tmp_path}/csv/*.csv")[0]) as f:
        lines = list(csv.reader(f))
    assert lines[0] == ["date", "route_id", "index_value", "frequency", "tier"]
    assert ["2024-07-01", "NATIONAL", "104.26", "daily", "Composite"] in lines
    quotes.export_json(rows, str(tmp_path / "json"))
    quotes.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    raw = spark.createDataFrame([("07", "105.9", "4.6"), ("07", "bad", None)], "code string, index string, inflation string")
    for load in (1, 2):
        cpi.append_cpi(cpi.normalize_cpi(raw.withColumn("division", F.lit("Transport"))), str(tmp_path / "cpi"), load)
    stored = spark.read.parquet(str(tmp_path / "cpi"))
    assert stored.count() == 4 and cpi.cpi_select(stored, "transport").count() == 4
    found = {r.kind: r for r in cpi.cpi_benchmarks(stored).collect()}
    assert found["airfare"].index_value == 135.49 and found["transport"].month == "August"


PAGE = "source string, own_carrier string, origin_iata string, destination_iata string, travel_date date, advance_days int, body string"


def page(spark, body, carrier="6E"):
    import datetime
    return spark.createDataFrame([("indigo", carrier, "DEL", "BOM", datetime.date(2024, 3, 1), 7, body)], PAGE)


def test_json_pages(spark):
    flights = [{"flightNumber": str(100 + i), "fare": 5000 + i} for i in range(20)]
    assert pages.quotes_from_json(page(spark, json.dumps({"trips": flights})), "body").count() == 20
    assert pages.quotes_from_json(page(spark, json.dumps({"data": {"fares": flights}})), "body", "agency").count() == 20
    mixed = {"flights": {"journeys": []}, "results": [
        {"flightNo": "AI 202", "price": {"amount": "1,25,0.5"}, "depTime": "2024-03-01T07:05", "arrTime": "9:10"},
        {"carrier": "sg", "flightNumber": 8169, "totalFare": 0, "amount": 7000}, {"price": 500}, {"price": 40000}, "odd"]}
    rows = {r.flight_number: r for r in pages.quotes_from_json(page(spark, json.dumps(mixed)), "body", "agency").collect()}
    assert set(rows) == {"AI-202", "SG-8169"}
    assert float(rows["AI-202"].raw_total_fare) == 1250.5 and rows["AI-202"].arrival_time == "09:10"
    parts = rows["SG-8169"]
    assert sum(float(parts[c]) for c in ("raw_base_fare", "raw_fuel_surcharge", "raw_taxes", "raw_udf", "raw_psf", "raw_convenience_fee")) == pytest.approx(7000)


def test_embedded_and_card_pages(spark):
    state = '<script>window.flightSearchData = {"flights":[{"flightNumber":"6E-1","fare":4500}]};</script>'
    assert pages.quotes_from_embedded_state(page(spark, state), "body").count() == 1
    cards = "".join(f'<div class="c flight-item x"><span>6E {200 + i}</span> 06:10 <b>8:20</b> INR 4,{500 + i}</div>' for i in range(12))
    other = '<div class="flight-item">AI 101 07:00 09:00 Rs. 5000</div>'
    rows = pages.quotes_from_cards(page(spark, f"<html>{other}{cards}</html>"), "body").collect()
    assert len(rows) == 12 and {(r.departure_time, r.arrival_time) for r in rows} == {("06:10", "08:20")}
    agency = pages.quotes_from_cards(page(spark, f"<html>{other}{cards}</html>"), "body", "agency")
    assert agency.count() == 13
    assert pages.quotes_from_cards(page(spark, "<p>nothing here</p>"), "body").count() == 0
    outer = '<div class="flight-item">6E 111 06:00 07:00 <div>Rs. 4100 <div class="flight-item">6E 222 08:00 09:30 Rs. 5200</div></div></div>'
    after = '<p>From Rs. 9999, 6E 999</p><div class="flight-item">6E 333 <br/><div>10:00 11:00</div>Rs. 6300</div> INR 7777 <footer>6E 444 Rs. 1500</footer>'
    rows = pages.quotes_from_cards(page(spark, f"<html><body>{outer}{after}</body></html>"), "body").collect()
    assert sorted((r.flight_number, float(r.raw_total_fare), r.departure_time) for r in rows) == [
        ("6E-111", 4100.0, "06:00"), ("6E-222", 5200.0, "08:00"), ("6E-333", 6300.0, "10:00")]
    unclosed = '<div class="flight-item">6E 111 <div>Rs. 4100<div class="flight-item">6E 222 Rs. 5200</div><p>7:00 8:00</p>'
    rows = pages.quotes_from_cards(page(spark, unclosed), "body").collect()
    assert sorted((r.flight_number, float(r.raw_total_fare), r.departure_time) for r in rows) == [("6E-111", 4100.0, "08:00"), ("6E-222", 5200.0, "08:00")]
    footer = '<div class="flight-item">6E 101</div><footer>Fees from Rs. 4999, 10:00 to 18:00</footer>'
    assert pages.quotes_from_cards(page(spark, f"<html>{footer}</html>"), "body").count() == 0


@pytest.mark.parametrize("files, per_batch", [(1, None), (4, None), (4, 1)])
def test_streams_match_batch_for_any_layout(spark, sample, tmp_path, files, per_batch):
    """One file, a folder of files, and a file to a micro-batch in shuffled order."""
    lines = tables.table(spark, sample, "lineitem")
    if files == 1:
        source = sample
    else:
        source = str(tmp_path)
        lines.repartition(files, F.rand(5)).write.parquet(f"{source}/lineitem.parquet")
    facts = lambda df: tables.facts_of(df)
    stream = facts(flows.table_stream(spark, source, "lineitem", per_batch))
    batch = tables.facts(spark, sample)
    ids = F.substring_index("quote_id", "-", 2).alias("id")
    got = flows.run_first_sights(flows.stream_dedup(stream.select(ids), "id"), str(tmp_path / "ids"), str(tmp_path / "ids-ck"), "id")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in batch.select(ids).distinct().collect())
    found = flows.run_trunk_volatility(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = flows.trunk_volatility(batch)
    key = lambda r: (r.window.start, r.sector, r.advance_days)
    got, want = sorted(found.collect(), key=key), sorted(want.collect(), key=key)
    assert [key(r) + (r.quotes,) for r in got] == [key(r) + (r.quotes,) for r in want] and got
    assert [r.std_fare for r in got] == pytest.approx([r.std_fare for r in want], abs=1e-6)


@pytest.mark.parametrize("shuffled", [False, True])
def test_published_stream_over_batches_matches_the_fold(spark, tmp_path, shuffled):
    """Four batches give the batch series; late periods come with corrections of what followed."""
    rows = [(s, f"2024-{m:02d}-01", 100.0 + (m * k * 7) % 13) for k, s in enumerate("abc", start=1) for m in range(1, 11)]
    schema = "series_id string, period string, level double"
    folder = str(tmp_path / "levels")
    part = (lambda i: (i * 7) % 4) if shuffled else (lambda i: i % 10 * 4 // 10)
    parts = [[r for i, r in enumerate(rows) if part(i) == k] for k in range(4)]
    spark.createDataFrame([], schema).write.parquet(folder)
    for k in range(4):
        spark.createDataFrame(parts[k] + parts[0][:3], schema).coalesce(1).write.mode("append").parquet(folder)  # repeats are ignored
        stream = spark.readStream.schema(schema).parquet(folder)
        got = flows.run_published_series(stream, str(tmp_path / "out"), str(tmp_path / "ck"), length=4)
    want = multilateral.rygeks_series(spark.createDataFrame(rows, schema), length=4)
    key = ("series_id", "period", "published_index", "window_length", "level_adjustment_factor")
    left = sorted(tuple(r[c] for c in key) for r in flows.latest_published(got).collect())
    right = sorted(tuple(r[c] for c in key) for r in want.collect())
    assert [r[:2] + r[3:4] for r in left] == [r[:2] + r[3:4] for r in right]
    assert [r[2] for r in left] == pytest.approx([r[2] for r in right], abs=1.5e-4) and [r[4] for r in left] == pytest.approx([r[4] for r in right], abs=2e-6)
    given = got.collect()
    assert sum(r.kind == "published" for r in given) == len(rows)  # each period once
    assert any(r.kind == "correction" for r in given) == shuffled


def test_upsert_stream_in_two_batches(spark, sample, tmp_path):
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    seen = []
    for part in ("l_orderkey % 6 = 0", "l_orderkey % 6 = 3"):
        quotes.write_quotes(normalize.normalize_quotes(tables.raw_quotes_of(some_lines(spark, sample, part))), inbox, "append")
        stream = flows.read_quote_stream(spark, inbox)
        flows.run_batches(stream, flows.upsert_batches(store, on_batch=lambda facts, i: seen.append(i)), str(tmp_path / "ck"))
    rows = quotes.read_store(spark, store)
    assert seen == [0, 1] and rows.count() == rows.select("quote_id").distinct().count() > 0


def test_merge_settles_flights_and_empties_months(spark, sample, tmp_path):
    store = str(tmp_path / "store")
    raw = normalize.normalize_quotes(tables.raw_quotes_of(some_lines(spark, sample, "l_orderkey % 3 = 0")))
    facts = quotes.to_facts(normalize.validate_quotes(raw)[0]).dropDuplicates(["quote_id"])
    quotes.write_store(facts, store)
    month = F.date_format("travel_date", "yyyy-MM")
    first = facts.select(F.min(month)).first()[0]
    moved = facts.filter(month == first).withColumn("travel_date", F.add_months("travel_date", 500))
    quotes.merge_store(spark, store, moved)
    rows = quotes.read_store(spark, store)
    assert rows.count() == facts.count() and rows.filter(month == first).count() == 0
    quotes.merge_store(spark, store, facts.withColumn("quote_id", F.concat("quote_id", F.lit("-again"))), per_flight=True)
    again = quotes.read_store(spark, store).filter(month != first).filter(month < "2030")
    assert again.count() == quotes.one_per_flight(facts.filter(month != first)).count()


def test_upsert_over_batches_has_the_flights_of_one(spark, sample, tmp_path):
    """Four micro-batches in shuffled order leave the flights that one batch leaves."""
    lines = tables.table(spark, sample, "lineitem").filter("l_orderkey % 2 = 0")
    lines.repartition(4, F.rand(3)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {}
    for name, per_batch in (("one", None), ("four", 1)):
        raw = tables.raw_quotes_of(flows.table_stream(spark, str(tmp_path), "lineitem", per_batch))
        store = str(tmp_path / name)
        flows.run_batches(raw, flows.upsert_batches(store), str(tmp_path / f"{name}-ck"))
        rows = quotes.read_store(spark, store).select("quote_id", "total_fare").collect()
        got[name] = sorted(map(tuple, rows))
    assert got["one"] == got["four"]


def test_both_forms_of_a_cohort_join_agree(spark):
    from fareloom.operators.joins import join_cohort
    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(60)], "k int, v double")
    side = spark.createDataFrame([(0, "a"), (1, "b")], "k int, name string")
    for how in ("inner", "left", "left_semi"):
        small, large = (join_cohort(rows, side, ["k"], how, max_rows=m) for m in (10, 1))
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.columns == large.columns


def test_late_period_is_published_and_what_follows_corrected(spark, tmp_path):
    schema, folder = "series_id string, period string, level double", str(tmp_path / "levels")
    spark.createDataFrame([], schema).write.parquet(folder)
    for part in ([("a", "2024-01", 100.0), ("a", "2024-03", 110.0)], [("a", "2024-02", 150.0), ("a", "2024-03", 110.0), ("a", "2024-04", 121.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        got = flows.run_published_series(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "out"), str(tmp_path / "ck"), length=4)
    rows = sorted((r.period, r.batch_id, r.kind, r.window_length, r.published_index) for r in got.collect())
    assert rows == [("2024-01", 0, "published", 1, 100.0), ("2024-02", 1, "published", 2, 150.0), ("2024-03", 0, "published", 2, 110.0),
                    ("2024-03", 1, "correction", 3, 110.0), ("2024-04", 1, "published", 4, 121.0)]


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    odd = ['{"a": [', 'brace } and { in "text"', "back\\slash\\", '\\"}', "}{", '"', "line\nbreak }, {", ""]
    rows = [{"id": i, "text": odd[i % len(odd)] * (i % 3 + 1), "inner": {"n": i, "deep": {"t": "}" * (i % 4)}}, "list": [{"k": "{"}] * (i % 3)} for i in range(3000)]
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps(rows, indent=1))
    (folder / "two.json").write_text(json.dumps(rows[:7]))
    (folder / "three.json").write_text("\n".join(map(json.dumps, rows[7:9])))
    (folder / "four.json").write_text("[]")
    (folder / "five.json").write_text(json.dumps(rows[9]))
    (folder / "cut.json").write_text(json.dumps(rows[10:12])[:-20])
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "}").text(str(folder)).rdd.getNumPartitions() > 20
        found = [json.loads(r.value) for r in quotes.json_objects(spark, str(folder)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    order = lambda rows: sorted(map(json.dumps, rows))
    assert order(found) == order(rows + rows[:7] + rows[7:9] + rows[9:10] + rows[10:11])


def test_quote_files_are_small_and_read_without_a_shuffle_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quotes, "FILE_QUOTES", 40)
    rows = spark.range(100).select(F.concat(F.lit('q"{}\\'), "id").alias("quote_id"), F.lit(4500.0).alias("total_fare"))
    path = str(tmp_path / "files")
    quotes.write_quotes(rows.coalesce(1), path)
    assert [f.endswith(".txt.gz") for f in sorted(os.listdir(path)) if f.startswith("part-")] == [True] * 3
    objects = quotes.json_objects(spark, path)
    assert "Exchange" not in objects._jdf.queryExecution().executedPlan().toString()
    assert sorted(json.loads(r.value)["quote_id"] for r in objects.collect()) == sorted(r.quote_id for r in rows.collect())
    for multi_line in (False, True):
        assert quotes.read_quotes(spark, path, multi_line).filter("raw_total_fare = 4500").count() == 100


def test_a_page_and_its_prices_are_read_once(spark):
    page = '<script>window.__INITIAL_STATE__ = {"data":{"flights":[%s]}};</script>'
    items = ['{"flightNumber":"101","totalFare":{"total":0,"amount":"4,500"}}', '{"flightNo":"AI202","price":"5100"}', '{"fare":{"value":{"x":1}}}', '{"fare":false,"amount":4100.5}']
    df = spark.createDataFrame([(page % ",".join(items), "AI"), (None, "AI"), ("<p>", "AI")], "html string, own_carrier string")
    df = df.select(F.upper("html").alias("other"), F.concat("html", F.lit(" ")).alias("html"), "own_carrier", F.lit("x").alias("source"), F.lit("DEL").alias("origin_iata"),
                   F.lit("BOM").alias("destination_iata"), F.to_date(F.lit("2024-03-01")).alias("travel_date"), F.lit(7).alias("advance_days"))
    found = pages.quotes_from_embedded_state(df)
    rows = found.select("position", "flight_number", F.col("raw_total_fare").cast("double").alias("fare")).collect()
    assert sorted(map(tuple, rows)) == [(0, "AI-101", 4500.0), (1, "AI202", 5100.0), (3, "AI-1003", 4100.5)]
    plan = found.select("raw_total_fare")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.total") == 1 and plan.count("get_json_object") == 4  # one for the page, three for a price
