"""Every checked query: a function of (spark, sf_dir) and, where SQL can say it, its SQL.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import numeric, text
from fareloom.functions.numeric import to_places
from fareloom.operators import (analytics, decompose, dedup, elementary, movements, multilateral, national, normalize,
                                quality, ranking, route, screening, tagging, validation)
from fareloom.plans import oracle as O
from fareloom.plans import publish
from fareloom.plans.oracle import R, with_
from fareloom.session import computed_once
from fareloom.session import stored as stored_once
from fareloom.sources import cpi, pages, quotes, tables, weights
from fareloom.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query
    return register


def day(column: str, name: str | None = None) -> Column:
    return F.col(column).cast("string").alias(name or column)


# --- flagship --------------------------------------------------------------------------

REGION_GRID = """grid as (select sector,w advance_days,a*1.0/sum(a) over () omega from (select distinct sector from region_use),
 (values (1,0.05::double),(7,0.2::double),(15,0.3::double),(30,0.3::double),(45,0.15::double)) v(w,a))"""


@check("national_index_by_year", with_(*O.REGION_INDEX, REGION_GRID) + f"""
select r.period as "year", {R('sum(omega*index_value*100)/case when count(*)=(select count(*) from grid) then 1.0::double else sum(omega) end', 4)} composite_index,
(select count(*) from grid)-count(*) missing_cells_count from route r join grid using (sector,advance_days) group by 1""")
def national_index_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Stages 1 to 3 on region pairs, base 1995."""
    usable = tables.region_quotes(spark, sf).filter(F.col("total_fare").between(C.FARE_FLOOR, C.FARE_CEILING))
    elem = elementary.elementary_indices(usable, "year", 1995)
    cells = route.route_indices(elem, ["year"], tables.REGION_SHARES, details=False)
    sectors = usable.select("sector").distinct().withColumn("weight", F.lit(1.0))
    windows = spark.createDataFrame(list(C.WINDOW_WEIGHTS.items()), "advance_days int, weight double")
    omega = national.omega_grid(sectors, windows)
    return national.national_laspeyres(cells, omega, ["year"]).select("year", "composite_index", "missing_cells_count")


# --- sources ----------------------------------------------------------------------------

@check("s1_read_quotes", with_(*O.BASE) + "select quote_id,origin_iata,carrier_code,cast(travel_date as varchar) travel_date,raw_total_fare,advance_days from norm")
def s1(spark, sf):
    lines = quotes.quote_json(tables.raw_quotes(spark, sf))
    from fareloom.sources.schemas import RAW_QUOTE_FILE
    parsed = lines.select(F.from_json("value", RAW_QUOTE_FILE).alias("q")).select("q.*")
    return normalize.normalize_quotes(parsed).select(
        "quote_id", "origin_iata", "carrier_code", day("travel_date"), F.col("raw_total_fare").cast("double"), "advance_days")


@check("s2_write_quotes", with_(*O.BASE) + "select quote_id,printf('%.2f',raw_total_fare) fare,cast(travel_date as varchar) travel_date,strftime(scrape_timestamp,'%Y-%m-%dT%H:%M:%S') seen from norm")
def s2(spark, sf):
    shown = {"quote_id": "quote_id", "raw_total_fare": "fare", "travel_date": "travel_date", "scrape_timestamp": "seen"}
    # the text is parsed once for all of its members
    quote = F.from_json("value", ",".join(f"{name} string" for name in shown)).alias("q")
    written = computed_once(quotes.quote_json(tables.normalized_quotes(spark, sf)), value=F.col("value"))
    return written.select(quote).select(*[F.col(f"q.{name}").alias(c) for name, c in shown.items()])


def weight_document(spark: SparkSession, sf: str) -> DataFrame:
    """A weight file made from the quotes: counts by sector, window and carrier."""
    usable = tables.usable_facts(spark, sf)

    def entries(key: str, name: str, value: Column) -> Column:
        counted = usable.groupBy(key).agg(F.count(F.lit(1)).alias("weight"))
        return counted.agg(F.map_from_entries(F.collect_list(F.struct(
            name_of(key), value))).alias("m")).scalar().alias(name)

    def name_of(key: str) -> Column:
        return F.concat(F.lit("T+"), F.col(key)) if key == "advance_days" else F.col(key)

    share = F.struct(F.col("weight").alias("market_share"))
    sector = F.struct("weight", numeric.lookup("sector", C.SECTOR_TIERS, "Trunk", "string").alias("route_tier"),
                      numeric.lookup("sector", {k: v[0] for k, v in C.SECTOR_SPECS.items()}, 1000, "int").alias("distance_km"))
    return spark.range(1).select(F.to_json(F.struct(
        entries("sector", "sectors", sector), entries("advance_days", "distribution", F.col("weight")),
        entries("carrier_code", "carrier_market_shares", share))).alias("doc"))


@check("s3_read_sector_weights", with_(*O.USE) + f"select sector,{O.case('sector', C.SECTOR_TIERS)} route_tier,{R('count(*)*1.0::double/sum(count(*)) over ()', 9)} weight from usable group by sector")
def s3(spark, sf):
    return weights.sector_weights_from(weight_document(spark, sf), expect=None).select("sector", "route_tier", to_places("weight", 9).alias("weight"))


@check("s4_read_window_weights", with_(*O.USE) + f"select advance_days,{R('count(*)*1.0::double/sum(count(*)) over ()', 9)} weight from usable group by 1")
def s4(spark, sf):
    return weights.window_weights_from(weight_document(spark, sf)).select("advance_days", to_places("weight", 9).alias("weight"))


@check("s5_read_carrier_shares", with_(*O.USE) + "select carrier_code,cast(count(*) as double) market_share from usable group by 1")
def s5(spark, sf):
    return weights.carrier_shares_from(weight_document(spark, sf))


@check("s6_read_sector_specs", with_(*O.USE) + f"select sector,cast({O.case('sector', {k: v[0] for k, v in C.SECTOR_SPECS.items()})} as int) distance_km,120 approx_flight_minutes from usable group by sector")
def s6(spark, sf):
    return weights.sector_specs_from(weight_document(spark, sf))


def cpi_records(spark: SparkSession, sf: str) -> DataFrame:
    return _cpi_with_id(tables.cpi_records_of(tables.table(spark, sf, "orders")))


def _cpi_with_id(raw: DataFrame) -> DataFrame:
    """S7 keeps declared columns only; the id travels in ``imputation``."""
    carried = raw.withColumn("imputation", F.col("record_id").cast("string"))
    return cpi.normalize_cpi(carried).withColumn("record_id", F.col("imputation").cast("bigint"))


@check("s7_read_cpi_records", with_(O.CPI) + 'select record_id,"year","month",state,sector,division,code,item_class,index_value,inflation_pct from cpi')
def s7(spark, sf):
    return cpi_records(spark, sf).select("record_id", "year", "month", "state", "sector", "division", "code", "item_class", "index_value", "inflation_pct")


for _kind, _where in {"airfare": f"code='{C.CPI_AIRFARE_CODE}'", "transport": "code='07' or division like '%Transport%'", "general": "division='CPI (General)'"}.items():
    check(f"s8_cpi_select_{_kind}", with_(O.CPI) + f"select record_id,code,division,index_value from cpi where {_where}")(
        lambda spark, sf, kind=_kind: cpi.cpi_select(cpi_records(spark, sf), kind).select("record_id", "code", "division", "index_value"))


@check("w9_latest_cpi", with_(O.CPI) + "select base_year,code,record_id,index_value from (select *,row_number() over (partition by base_year,code order by record_id desc) rn from cpi where state='All India' and sector='Combined') where rn=1")
def w9(spark, sf):
    return cpi.latest_cpi(cpi_records(spark, sf)).select("base_year", "code", "record_id", "index_value")


@check("a31_cpi_benchmarks", with_(O.CPI) + f"""
select k.kind,k.code,coalesce(c.index_value,k.di) index_value,case when c.code is null then k.df else c.inflation_pct end inflation_pct,coalesce(c."month",'August') "month",coalesce(c."year",'2026') "year"
from (values ('airfare','{C.CPI_AIRFARE_CODE}',135.49::double,20.85::double),('transport','07',105.90::double,4.60::double)) k(kind,code,di,df)
left join (select * from (select *,row_number() over (partition by code order by record_id desc) rn from cpi where state='All India' and sector='Combined' and base_year='2024') where rn=1) c on c.code=k.code""")
def a31(spark, sf):
    return cpi.cpi_benchmarks(cpi_records(spark, sf)).select("kind", "code", "index_value", "inflation_pct", "month", "year")


@check("s10_upsert_quotes", with_(*O.FACT) + """select id,quote_id,total_fare from (select *,row_number() over (partition by id order by b desc,scrape_timestamp desc,quote_id desc) rn
 from (select *,concat_ws('-',l_orderkey,l_linenumber) id,case when l_returnflag='R' then 1 else 0 end b from facts)) where rn=1""")
def s10(spark, sf):
    lines = tables.table(spark, sf, "lineitem")
    parts = [tables.facts_of(lines.filter(F.col("l_returnflag") != "R")), tables.facts_of(lines.filter(F.col("l_returnflag") == "R"))]
    stored, batch = [p.select(F.substring_index("quote_id", "-", 2).alias("id"), "quote_id", "scrape_timestamp", "total_fare") for p in parts]
    return quotes.upsert_quotes(stored, batch, "id", ("scrape_timestamp", "quote_id")).select("id", "quote_id", "total_fare")


def crawled(spark: SparkSession, sf: str) -> DataFrame:
    """A page per valid quote that lists two flights: the quote's and one 10 % dearer."""
    q = tables.valid_quotes(spark, sf).filter(F.col("raw_total_fare") > 0)
    fare = F.col("raw_total_fare").cast("double")
    dear = F.floor(fare * 110) / 100
    return q.select("quote_id", "source", "source_type", "origin_iata", "destination_iata", "travel_date", "advance_days",
                    F.col("carrier_code").alias("own_carrier"), text.normalize_flight("flight_number").alias("flight"),
                    "departure_time", "arrival_time", fare.alias("fare"), dear.alias("dear"),
                    F.col("quote_id").alias("page_id"))


def payload() -> Column:
    number = F.substring("flight", 3, 10)
    first = F.to_json(F.struct(number.alias("flightNumber"), F.col("departure_time").alias("depTime"),
                               F.col("arrival_time").alias("arrivalTime"), F.struct(F.col("fare").alias("total")).alias("totalFare")))
    second = F.to_json(F.struct(F.col("flight").alias("flightNo"), F.col("own_carrier").alias("carrier"), F.col("dear").alias("price")))
    return F.concat(F.lit('{"status":"ok","data":{"flights":['), first, F.lit(","), second, F.lit("]}}"))


EXTRACTED = f"""pg as (select *, regexp_replace(upper(flight_number),'[^A-Z0-9]','','g') flight, floor(raw_total_fare*110)/100 dear from valid where raw_total_fare>0),
it as (select quote_id page_id,origin_iata,0 position,carrier_code||'-'||substr(flight,3) flight_number,departure_time,arrival_time,raw_total_fare fare,carrier_code,source from pg
 union all select quote_id,origin_iata,1,flight,'08:00','10:15',dear,carrier_code,source from pg),
ex as (select *, greatest(0.0::double,fare-u-180) pool from (select *,coalesce({O.case('origin_iata', C.UDF_EXTRACTION)},400.0::double) u from it where fare between 999 and 35000)),
raw2 as (select *, {R('pool/1.05::double', 2)} tx from ex)"""
EXTRACT_SQL = with_(*O.BASE, EXTRACTED) + f"select page_id,position,flight_number,departure_time,arrival_time,fare raw_total_fare,u raw_udf from raw2"
EXTRACT_COLUMNS = ["page_id", "position", "flight_number", "departure_time", "arrival_time"]


def _extracted(df: DataFrame) -> DataFrame:
    return df.select(*EXTRACT_COLUMNS, F.col("raw_total_fare").cast("double"), F.col("raw_udf").cast("double"))


@check("s12_quotes_from_json", EXTRACT_SQL)
def s12(spark, sf):
    return _extracted(pages.quotes_from_json(crawled(spark, sf).withColumn("payload", payload())))


@check("s13_quotes_from_embedded_state", EXTRACT_SQL)
def s13(spark, sf):
    script = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":'), payload(), F.lit("}}</script></html>"))
    state = F.concat(F.lit("<html><script>window.__INITIAL_STATE__ = "), payload(), F.lit(";</script></html>"))
    html = F.when(F.col("source_type") == "airline", script).otherwise(state)
    return _extracted(pages.quotes_from_embedded_state(crawled(spark, sf).withColumn("html", html)))


def listings(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    """A page per sector and year (and further keys) that lists all quotes of valid lines, in order of their id."""
    q = tables.valid_quotes(spark, sf).withColumn("yr", F.year("travel_date"))
    number = F.substring(text.normalize_flight("flight_number"), 3, 10)
    item = F.struct("quote_id", number.alias("flightNumber"), F.col("carrier_code").alias("carrierCode"), F.col("departure_time").alias("depTime"),
                    F.col("arrival_time").alias("arrivalTime"), F.col("raw_total_fare").cast("double").alias("price"))
    grouped = q.groupBy("origin_iata", "destination_iata", "yr", *keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("*", F.concat_ws("|", "origin_iata", "destination_iata", "yr", *keys).alias("page_id"), F.lit("indigo").alias("source"),
                          F.make_date("yr", F.lit(1), F.lit(1)).alias("travel_date"), F.lit(7).alias("advance_days"),
                          F.to_json(F.struct(F.col("items").alias("flights"))).alias("payload"))


def _listing_sql(keys: str, flight: str) -> str:
    page = f"concat_ws('|',origin_iata,destination_iata,year(travel_date){keys})"
    return with_(*O.BASE, f"it as (select *,{page} page_id,row_number() over (partition by {page} order by quote_id)-1 position,substr(regexp_replace(upper(flight_number),'[^A-Z0-9]','','g'),3) digits from valid)") + \
        f"select page_id,position,{flight} flight_number,departure_time,arrival_time,raw_total_fare,coalesce({O.case('origin_iata', C.UDF_EXTRACTION)},400.0::double) raw_udf from it where raw_total_fare between 999 and 35000"


@check("t4_all_items_airline", _listing_sql(",carrier_code", "carrier_code||'-'||digits"))
def t4_airline(spark, sf):
    df = listings(spark, sf, ["carrier_code"]).withColumnRenamed("carrier_code", "own_carrier")
    return _extracted(pages.quotes_from_json(df))


@check("t4_all_items_agency", _listing_sql("", "carrier_code||'-'||digits"))
def t4_agency(spark, sf):
    return _extracted(pages.quotes_from_json(listings(spark, sf, []), kind="agency"))


CARDS_SQL = with_(*O.BASE, f"pg as (select *, regexp_replace(upper(flight_number),'[^A-Z0-9]','','g') flight, cast(floor(raw_total_fare) as bigint) whole from valid where raw_total_fare>0)") + f"""
select quote_id page_id,0 position,carrier_code||'-'||substr(flight,3) flight_number,departure_time,arrival_time,cast(whole as double) raw_total_fare,
coalesce({O.case('origin_iata', C.UDF_EXTRACTION)},400.0::double) raw_udf from pg where whole between 1000 and 35000
union all select quote_id,1,carrier_code||'-'||substr(flight,3),'08:00','10:15',cast(whole+10 as double),coalesce({O.case('origin_iata', C.UDF_EXTRACTION)},400.0::double) from pg where whole+10 between 1000 and 35000"""


@check("s14_quotes_from_cards", CARDS_SQL)
def s14(spark, sf):
    whole = F.floor("fare")
    shown = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"))
    number = F.concat(F.col("own_carrier"), F.lit(" "), F.substring("flight", 3, 10))
    first = F.concat(F.lit('<div class="row flight-card"><b>'), number, F.lit("</b> "), F.col("departure_time"), F.lit(" <i>-</i> "),
                     F.col("arrival_time"), F.lit(" &#8377; "), shown, F.lit("</div>"))
    second = F.concat(F.lit('<div class="flight-card">'), number, F.lit(" Rs. "), (whole + 10).cast("string"), F.lit("</div>"))
    html = F.concat(F.lit("<html><body><h1>Fares</h1>"), first, second, F.lit("</body></html>"))
    df = crawled(spark, sf).filter(F.col("fare") >= 1000).withColumn("html", html)
    return _extracted(pages.quotes_from_cards(df))


@check("p8_split_total_70_30", with_(*O.BASE, EXTRACTED) + f"""select page_id,position,{R('b0+(fare-b0-f0-g0-u-180)', 2)} raw_base_fare,f0 raw_fuel_surcharge,g0 raw_taxes from
 (select *, {R('pool-b0-f0', 2)} g0 from (select *, cast(round_even(cast(tx as decimal(12,2))*cast(0.7 as decimal(3,2)),2) as double) b0,cast(round_even(cast(tx as decimal(12,2))*cast(0.3 as decimal(3,2)),2) as double) f0 from raw2 where position=0))""")
def p8(spark, sf):
    df = crawled(spark, sf).withColumns({"raw_total_fare": F.col("fare"), "raw_convenience_fee": F.lit(0.0)}).filter(
        F.col("fare").between(C.FARE_FLOOR, C.EXTRACT_FARE_MAX))
    return normalize.split_total_70_30(df).select("page_id", F.lit(0).alias("position"), *[
        F.col(c).cast("double") for c in ("raw_base_fare", "raw_fuel_surcharge", "raw_taxes")])


# --- projections and filters --------------------------------------------------------------

@check("p1_normalize_quotes", with_(*O.BASE) + "select quote_id,source,origin_iata,destination_iata,carrier_code,flight_number,departure_time,arrival_time,cast(travel_date as varchar) travel_date,advance_days,raw_total_fare,raw_convenience_fee from norm")
def p1(spark, sf):
    return tables.normalized_quotes(spark, sf).select(
        "quote_id", "source", "origin_iata", "destination_iata", "carrier_code", "flight_number", "departure_time", "arrival_time",
        day("travel_date"), "advance_days", F.col("raw_total_fare").cast("double"), F.col("raw_convenience_fee").cast("double"))


@check("p2_rejected_by_rule", with_(*O.BASE) + """select rule,count(*) quotes from (select unnest(list_filter([case when arrival_time is null then 'missing_arrival_time' end,
 case when origin_iata=destination_iata then 'same_airport' end,case when duration_minutes<=0 then 'bad_duration' end],lambda x: x is not null)) rule from norm) group by 1""")
def p2(spark, sf):
    rejected = normalize.validate_quotes(tables.normalized_quotes(spark, sf))[1]
    return rejected.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("quotes"))


@check("p2_valid_quotes", with_(*O.BASE) + "select quote_id,carrier_code,raw_total_fare from valid")
def p2_valid(spark, sf):
    return tables.valid_quotes(spark, sf).select("quote_id", "carrier_code", F.col("raw_total_fare").cast("double"))


@check("p3_reconcile_clean", with_(*O.FACT) + "select quote_id,sector,origin_iata,destination_iata,carrier_code,advance_days,data_quality_score,total_fare from facts")
def p3(spark, sf):
    older = tables.facts(spark, sf).select(
        "quote_id", "sector", F.col("carrier_code").alias("carrier"), F.col("advance_days").alias("advance_window"),
        F.col("data_quality_score").alias("quality_score"), F.struct(F.col("total_fare")).alias("decomposed_fare"))
    return normalize.reconcile_clean(older).select(
        "quote_id", "sector", "origin_iata", "destination_iata", "carrier_code", "advance_days", "data_quality_score", "total_fare")


@check("p4_handle_sold_out", with_(*O.BASE) + f"select quote_id,case when seats_available=0 and raw_total_fare<=0 then {C.SOLD_OUT_FARE}::double else raw_total_fare end raw_total_fare,seats_available,seats_available=0 is_sold_out from valid")
def p4(spark, sf):
    return normalize.handle_sold_out(tables.valid_quotes(spark, sf)).select(
        "quote_id", F.col("raw_total_fare").cast("double"), "seats_available", "is_sold_out")


PART_COLUMNS = ["base_fare", "fuel_surcharge", "airport_taxes_gst", "user_dev_fee", "passenger_service_fee", "convenience_fee", "total_fare"]


@check("p5_decompose_fare", with_(*O.BASE, O.parts("valid", fee="null")) + f"select quote_id,{','.join(PART_COLUMNS)} from pt")
def p5(spark, sf):
    return decompose.decompose_fare(tables.valid_quotes(spark, sf), exact=False, fee_override=None).select("quote_id", *PART_COLUMNS)


@check("p6_decompose_quotes", with_(*O.BASE, O.parts("valid")) + f"select quote_id,{','.join(PART_COLUMNS)} from pt")
def p6(spark, sf):
    return decompose.decompose_fare(tables.valid_quotes(spark, sf), exact=False).select("quote_id", *PART_COLUMNS)


@check("p7_is_balanced", with_(*O.BASE, O.parts("valid"), "gaps as (select round(abs(total_fare-(base_fare+fuel_surcharge+airport_taxes_gst+user_dev_fee+passenger_service_fee+convenience_fee)),2)+0.0::double gap from pt)") + "select gap<=1 is_balanced,count(*) quotes,max(gap) worst from gaps group by 1")
def p7(spark, sf):
    parts = decompose.decompose_fare(tables.valid_quotes(spark, sf)).select(
        decompose.is_balanced().alias("is_balanced"), decompose.residual().cast("double").alias("gap"))
    return parts.groupBy("is_balanced").agg(F.count(F.lit(1)).alias("quotes"), F.max("gap").alias("worst"))


@check("p9_clean_quotes", with_(*O.FACT) + "select quote_id,sector,total_fare,data_quality_score from facts where data_quality_score>=80 and not is_outlier and not is_quarantined and travel_date between date '1996-01-01' and date '1996-12-31'")
def p9(spark, sf):
    return quality.clean_quotes(tables.facts(spark, sf), "1996-01-01", "1996-12-31").select("quote_id", "sector", "total_fare", "data_quality_score")


@check("p10_window_key", "select ['T+','T_',''][l_orderkey%3+1]||l_linenumber label,case when l_linenumber in (1,7) then l_linenumber end window_days,count(*) n from lineitem group by all")
def p10(spark, sf):
    lines = tables.table(spark, sf, "lineitem")
    label = F.concat(F.get(F.array(F.lit("T+"), F.lit("T_"), F.lit("")), (F.col("l_orderkey") % 3).cast("int")), F.col("l_linenumber").cast("string"))
    return lines.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("window_days", text.window_days("label"))


@check("p11_query_quotes", with_(*O.FACT) + "select quote_id,carrier_code,total_fare from facts where sector='DEL-BOM' and advance_days=7 and carrier_code='6E' and source='indigo'")
def p11(spark, sf):
    return analytics.query_quotes(tables.facts(spark, sf), "del", "bom", advance_days=7, carrier="6e", source="Indigo").select("quote_id", "carrier_code", "total_fare")


@check("p12_search_fares", with_(*O.FACT) + f"select count(*) total_quotes,count(distinct sector) monitored_routes,count(distinct carrier_code) monitored_carriers,{R('avg(total_fare)', 2)} average_fare,min(total_fare) min_fare,max(total_fare) max_fare,{R('avg(data_quality_score)', 2)} average_dqs from facts where sector='DEL-BLR' and total_fare between 3000 and 8000")
def p12(spark, sf):
    return analytics.fare_stats(analytics.search_fares(tables.facts(spark, sf), "DEL", "BLR", 3000, 8000))


@check("p14_limit_violations", with_(*O.FACT) + "select sector,count(*) filter (total_fare<999) below,count(*) filter (total_fare>25000) above from facts group by 1")
def p14(spark, sf):
    fare = F.col("total_fare")
    return tables.facts(spark, sf).groupBy("sector").agg(
        F.count_if(quality.is_floor_violation(fare)).alias("below"), F.count_if(quality.is_ceiling_violation(fare)).alias("above"))


PREV = """dayf as (select origin_iata,destination_iata,carrier_code,regexp_replace(upper(flight_number),'[^A-Z0-9]','','g') fk,travel_date,source,cast(scrape_timestamp as date) sd,arg_max(raw_total_fare,(scrape_timestamp,quote_id)) df from valid group by all),
lagf as (select *,lag(df) over (partition by origin_iata,destination_iata,carrier_code,fk,travel_date,source order by sd) prev_fare from dayf),
prev as (select v.*,l.prev_fare from valid v left join lagf l on l.origin_iata=v.origin_iata and l.destination_iata=v.destination_iata and l.carrier_code=v.carrier_code and l.fk=regexp_replace(upper(v.flight_number),'[^A-Z0-9]','','g') and l.travel_date=v.travel_date and l.source=v.source and l.sd=cast(v.scrape_timestamp as date))"""


@check("w3_prev_fare", with_(*O.BASE, PREV) + "select quote_id,prev_fare from prev")
def w3(spark, sf):
    return dedup.previous_day_fare(tables.valid_quotes(spark, sf)).select("quote_id", "prev_fare")


@check("p15_temporal_surge", with_(*O.BASE, PREV) + "select quote_id,case when prev_fare<=0 then true else (raw_total_fare-prev_fare)/prev_fare*100>50 end is_surge from prev where prev_fare is not null")
def p15(spark, sf):
    rows = dedup.previous_day_fare(tables.valid_quotes(spark, sf)).filter(F.col("prev_fare").isNotNull())
    surge = quality.is_temporal_surge(F.col("prev_fare"), F.col("raw_total_fare").cast("double"), quality.OutlierLimits(surge_pct=50.0))
    return rows.select("quote_id", surge.alias("is_surge"))


def cohort_rows(spark, sf):
    rows = quality.with_cohort(dedup.deduplicate_quotes(tables.valid_quotes(spark, sf)))
    rows = stored_once(rows.select("quote_id", "raw_total_fare", *quality.COHORT), "cohort-rows")  # used twice: for the statistics and for the rows
    return quality.cohort_frame(rows, quality.cohort_stats(rows))


@check("p16_cross_source_variance", with_(*O.BASE, O.DEDUP, O.COHORT) + "select quote_id,case when cohort_median<=0 then true else abs(raw_total_fare-cohort_median)/cohort_median*100>50 end is_variance from co")
def p16(spark, sf):
    fare = F.col("raw_total_fare").cast("double")
    return cohort_rows(spark, sf).select("quote_id", quality.is_cross_source_variance(fare, F.col("cohort_median")).alias("is_variance"))


@check("p17_evaluate_outliers", with_(*O.CLEAN) + "select quote_id,array_to_string(flags,',') flags,is_outlier,outlier_reason from clean")
def p17(spark, sf):
    return quality.clean_quotes_batch(tables.valid_quotes(spark, sf)).select(
        "quote_id", F.concat_ws(",", "flags").alias("flags"), "is_outlier", "outlier_reason")


@check("p18_quality_score", with_(*O.CLEAN) + "select quote_id,s1 schema_completeness,s2 decomposition_integrity,s3 domain_and_bounds,s4 cross_source_concordance,s5 source_reliability,data_quality_score from clean")
def p18(spark, sf):
    return quality.clean_quotes_batch(tables.valid_quotes(spark, sf)).select("quote_id", "dqs.*", "data_quality_score")


@check("p19_eligibility", with_(*O.CLEAN) + "select data_quality_score>=80 is_index_eligible,is_quarantined,is_outlier,count(*) quotes from clean group by all")
def p19(spark, sf):
    return quality.clean_quotes_batch(tables.valid_quotes(spark, sf)).groupBy(
        "is_index_eligible", "is_quarantined", "is_outlier").agg(F.count(F.lit(1)).alias("quotes"))


@check("p20_clean_quotes_batch", with_(*O.CLEAN) + f"select quote_id,sector,{','.join(PART_COLUMNS)},is_sold_out,is_outlier,data_quality_score,is_quarantined from clean")
def p20(spark, sf):
    return quality.clean_quotes_batch(tables.valid_quotes(spark, sf)).select(
        "quote_id", "sector", *PART_COLUMNS, "is_sold_out", "is_outlier", "data_quality_score", "is_quarantined")


AFFORD = f"""select origin_iata,destination_iata,{R('fare', 2)} average_fare,{R('d', 2)} daily_income,{R('fare/d', 1)} wage_days_required,{R('5.0::double/(fare/d)*100', 1)} affordability_score,
 case when {R('5.0::double/(fare/d)*100', 1)}>=120 then 'Very Affordable' when {R('5.0::double/(fare/d)*100', 1)}>=90 then 'Affordable' when {R('5.0::double/(fare/d)*100', 1)}>=70 then 'Moderate' else 'High Cost Barrier' end affordability_rating
 from (select origin_iata,destination_iata,avg(total_fare) fare,any_value(({O.case('origin_iata', C.INCOMES, '250000.0::double')}+{O.case('destination_iata', C.INCOMES, '250000.0::double')})/2/365) d from facts group by 1,2)"""


@check("p21_a28_affordability", with_(*O.FACT) + AFFORD)
def p21(spark, sf):
    return analytics.national_affordability(tables.facts(spark, sf))


SCENARIOS = [("fuel_15", 15.0, 0.0), ("demand_5", 0.0, 5.0), ("both", 15.0, 5.0)]
SCENARIO_VALUES = ",".join(f"('{n}',{a}::double,{d}::double)" for n, a, d in SCENARIOS)


@check("p22_scenario_fares", with_(*O.FACT) + f"""select sector,{R('fare', 2)} average_fare,scenario,{R(R('fare', 2) + '*((a*0.42::double+d*0.55::double)/100)', 1)} delta_fare,{R(R('fare', 2) + '*(1.0::double+(a*0.42::double+d*0.55::double)/100)', 1)} projected_fare
 from (select sector,avg(total_fare) fare from facts group by 1),(values {SCENARIO_VALUES}) s(scenario,a,d)""")
def p22(spark, sf):
    means = tables.facts(spark, sf).groupBy("sector").agg(to_places(F.avg("total_fare"), 2).alias("average_fare"))
    return analytics.scenario_fares(means, SCENARIOS)


@check("p22_scenario_projection", with_(*O.YEARLY) + f"""select period as "year",{R('composite_index', 2)} baseline_index,{R('8.4::double+0', 2)} delta_pct,{R('composite_index*(1.0::double+(20.0::double*0.42::double+0.0::double*0.55::double)/100)', 2)} projected_index,
 {R('(20.0::double*0.42::double+0.0::double*0.55::double)*0.032::double*100', 2)} transport_impact_bps,{R('(20.0::double*0.42::double+0.0::double*0.55::double)*0.032::double*100*0.0943::double', 2)} headline_impact_bps from nat""")
def p22_index(spark, sf):
    base = yearly(spark, sf).select("yr", "composite_index", F.lit(20.0).alias("atf_change_pct"), F.lit(0.0).alias("demand_shock_pct"))
    return analytics.scenario_projection(base, F.col("composite_index")).select(
        F.col("yr").alias("year"), "baseline_index", "delta_pct", "projected_index", "transport_impact_bps", "headline_impact_bps")


@check("p23_cpi_impact", with_(*O.FACT) + f"""select sector,{R('ch', 4)} change_pct,{R(R('ch', 4) + '*0.032::double*100', 2)} transport_impact_bps,{R(R('ch', 4) + '*0.032::double*100*0.0943::double', 2)} headline_impact_bps
 from (select sector,(avg(total_fare) filter (year(travel_date)=2000)/avg(total_fare) filter (year(travel_date)=1999)-1)*100 ch from facts group by 1)""")
def p23(spark, sf):
    def mean(year: int) -> Column:
        return F.avg(F.when(F.year("travel_date") == year, F.col("total_fare")))
    moved = tables.facts(spark, sf).groupBy("sector").agg(to_places((mean(2000) / mean(1999) - 1.0) * 100.0, 4).alias("change_pct"))
    return analytics.cpi_impact(moved)


FACTORS = ",".join(f"{f}::double" for f in C.WEEKDAY_FACTORS)


@check("p24_forecast", with_(*O.FACT) + f"""select sector,day_offset,cast(fd as varchar) forecast_date,strftime(fd,'%A') day_name,{R('pt', 2)} projected,{R('pt-band', 2)} lower_confidence_95,{R('pt+band', 2)} upper_confidence_95 from
 (select *,lv*(1.0::double+day_offset*(0.5::double*0.42::double/30.0::double)/100)*[{FACTORS}][isodow(fd)] pt,day_offset*0.15::double+0.85::double band from
 (select sector,lv,i day_offset,d+cast(i as int) fd from (select sector,max(travel_date) d,avg(total_fare)/48.0::double lv from facts group by 1),range(1,15) r(i)))""")
def p24(spark, sf):
    base = tables.facts(spark, sf).groupBy("sector").agg(F.max("travel_date").alias("date"), (F.avg("total_fare") / 48.0).alias("value"))
    return analytics.forecast(base).select("sector", "day_offset", day("forecast_date"), "day_name", "projected", "lower_confidence_95", "upper_confidence_95")


@check("p25_outlier_rows", with_(*O.FACT) + "select quote_id,outlier_reason,data_quality_score from facts where is_outlier and data_quality_score>=70")
def p25(spark, sf):
    return quality.outlier_rows(tables.facts(spark, sf), 70.0).select("quote_id", "outlier_reason", "data_quality_score")


_WORD = "(?:^|[^a-z0-9_])", "(?:[^a-z0-9_]|$)"
_CITY_LIST = C.CITY_WORDS + [(a[0].lower(), a[0]) for a in C.AIRPORTS]
_CITIES = "[" + ",".join(f"case when regexp_matches(q,'{_WORD[0]}{w}{_WORD[1]}') then '{i}' end" for w, i in _CITY_LIST) + "]"
_CARRIER = "case " + " ".join(f"when regexp_matches(q,'{_WORD[0]}{w}{_WORD[1]}') then '{c}'" for w, c in C.CARRIER_WORDS) + " end"
_INTENT = "case " + " ".join("when " + " or ".join(f"contains(q,'{w}')" for w in ws) + f" then '{n}'" for n, ws in C.INTENT_WORDS) + " when origin is not null then 'route_query' else 'general_overview' end"


def _tag_sql(source: str, keys: str) -> str:
    return f"""with t0 as (select {keys},lower(trim(text)) q from {source}),
t1 as (select *,upper(regexp_extract(q,'{tagging.SECTOR}',1)) po,upper(regexp_extract(q,'{tagging.SECTOR}',2)) pd,list_filter({_CITIES},lambda x: x is not null) cs,try_cast(regexp_extract(q,'{tagging.WINDOW}',1) as int) wd from t0),
t2 as (select *,list_filter(cs,lambda x,i: list_position(cs,x)=i) c from t1),
t3 as (select *,case when po in ({O.quoted(C.INCOMES)}) and pd in ({O.quoted(C.INCOMES)}) then po else c[1] end origin,case when po in ({O.quoted(C.INCOMES)}) and pd in ({O.quoted(C.INCOMES)}) then pd else c[2] end destination from t2)
select {keys},origin,destination,case when origin is not null and destination is not null then origin||'-'||destination end sector,{_CARRIER} carrier_code,case when wd in (1,7,15,30,45) then wd end advance_window,{_INTENT} intent from t3"""


TAGS = ["origin", "destination", "sector", "carrier_code", "advance_window", "intent"]


@check("p26_tag_conversations", _tag_sql("conversations", "conv_id,turn"))
def p26(spark, sf):
    return tagging.tag_queries(tables.table(spark, sf, "conversations")).select("conv_id", "turn", *TAGS)


@check("p26_tag_documents", _tag_sql("documents", "doc_id"))
def p26_docs(spark, sf):
    return tagging.tag_queries(tables.table(spark, sf, "documents")).select("doc_id", *TAGS)


_ASK = """(select l_orderkey||'-'||l_linenumber||'-'||l_partkey k,['Cheapest carrier ','What if fuel rises ','Surge on ','Lead time curve ','Index today ','Fare '][l_partkey%6+1]||
 case when l_orderkey%2=0 then lower(ring) else ['Delhi','Mumbai','Goa','Pune','Nowhere'][l_suppkey%5+1]||' and '||['Chennai','Lucknow','Bangalore'][l_partkey%3+1] end||' on '||['indigo','air india','spicejet','nobody'][l_orderkey%4+1]||' T+'||lead_days text from lines)"""


@check("p26_tag_queries", "with " + O.LINES + ", asks as " + _ASK + "," + _tag_sql("asks", "k").removeprefix("with "))
def p26_queries(spark, sf):
    def pick(values, index):
        return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ring = pick(tables.SECTOR_RING, (p * 3 + s) % 32)
    cities = F.concat(pick(["Delhi", "Mumbai", "Goa", "Pune", "Nowhere"], s % 5), F.lit(" and "), pick(["Chennai", "Lucknow", "Bangalore"], p % 3))
    asked = F.concat(
        pick(["Cheapest carrier ", "What if fuel rises ", "Surge on ", "Lead time curve ", "Index today ", "Fare "], p % 6),
        F.when(o % 2 == 0, F.lower(ring)).otherwise(cities), F.lit(" on "),
        pick(["indigo", "air india", "spicejet", "nobody"], o % 4), F.lit(" T+"), pick(C.WINDOWS, F.col("l_linenumber") % 5).cast("string"))
    rows = tables.table(spark, sf, "lineitem").select(F.concat_ws("-", o, "l_linenumber", p).alias("k"), asked.alias("text"))
    return tagging.tag_queries(rows).select("k", *TAGS)


@check("p27_heatmap", with_(*O.FACT) + f"""select sector,{O.case('origin_iata', {a[0]: a[2] for a in C.AIRPORTS}, '28.55::double')} origin_lat,{O.case('destination_iata', {a[0]: a[3] for a in C.AIRPORTS}, '77.1::double')} destination_lon,
 {R('avg(total_fare)', 1)} average_fare,{R('least(1.0::double,avg(total_fare)/10000)', 2)} intensity_score,{O.case('sector', {r[0]: r[8] for r in C.SECTORS})} annual_pax_millions,{O.case('sector', C.SECTOR_TIERS, "'Trunk'")} tier from facts group by sector,origin_iata,destination_iata""")
def p27(spark, sf):
    return analytics.heatmap(tables.facts(spark, sf)).select("sector", "origin_lat", "destination_lon", "average_fare", "intensity_score", "annual_pax_millions", "tier")


@check("p28_valid_codes", with_(*O.BASE) + "select origin_iata,regexp_full_match(origin_iata,'[A-Z]{3}') valid_origin,regexp_full_match(origin_iata||'-'||destination_iata,'[A-Z]{3}-[A-Z]{3}') valid_sector,count(*) n from norm group by all")
def p28(spark, sf):
    raw = tables.raw_quotes(spark, sf)
    sector = F.concat_ws("-", text.code("origin"), "destination")
    return raw.select(text.code("origin").alias("origin_iata"), text.valid_iata("origin").alias("valid_origin"),
                      text.valid_sector(sector).alias("valid_sector")).groupBy("origin_iata", "valid_origin", "valid_sector").agg(F.count(F.lit(1)).alias("n"))


@check("p29_normalize_flight", with_(*O.BASE) + "select regexp_replace(upper(flight_number),'[^A-Z0-9]','','g') flight,count(*) n from norm group by 1")
def p29(spark, sf):
    return tables.raw_quotes(spark, sf).select(text.normalize_flight("flight_number").alias("flight")).groupBy("flight").agg(F.count(F.lit(1)).alias("n"))


@check("p30_reporting_lead_time", "select case when d<=1 then 1 when d<=7 then 7 when d<=15 then 15 when d<=30 then 30 else 45 end lead_time,count(*) n from (select l_partkey%60 d from lineitem) group by 1")
def p30(spark, sf):
    lines = tables.table(spark, sf, "lineitem").select(text.reporting_lead_time(F.col("l_partkey") % 60).alias("lead_time"))
    return lines.groupBy("lead_time").agg(F.count(F.lit(1)).alias("n"))


# --- stage 1 to 3 -----------------------------------------------------------------------

def yearly_elementary(spark: SparkSession, sf: str) -> DataFrame:
    usable = tables.usable_facts(spark, sf).withColumn("yr", F.year("travel_date"))
    return elementary.elementary_indices(usable, "yr", 1995)


def yearly_routes(spark: SparkSession, sf: str) -> DataFrame:
    return route.route_indices(yearly_elementary(spark, sf), ["yr"], details=False)


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    return national.national_laspeyres(yearly_routes(spark, sf), national.default_omega(spark), ["yr"])


ELEMENTARY_COLUMNS = "sector,carrier_code,advance_days,base_quote_count,current_quote_count,matched_quote_count,base_geometric_mean,current_geometric_mean,index_value"


@check("a4_elementary_indices", with_(*O.YEARLY) + f"select period yr,{ELEMENTARY_COLUMNS} from elem")
def a4(spark, sf):
    return yearly_elementary(spark, sf)


def two_years(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two last whole years of the data: the last one may be cut off, so it is left out."""
    usable = tables.usable_facts(spark, sf)
    last = usable.agg(F.max(F.year("travel_date")) - 1).scalar()
    return usable.filter(F.year("travel_date") == last - 1), usable.filter(F.year("travel_date") == last)


# the two last whole years of the data, under the labels 1999 and 2000
LABELS = "select *,case when year(travel_date)=(select max(year(travel_date))-1 from usable) then 2000 else 1999 end yr from usable where year(travel_date) between (select max(year(travel_date))-2 from usable) and (select max(year(travel_date))-1 from usable)"
TWO = (*O.USE, f"usable_y as ({LABELS})",
       *O.elementary("usable_y", "yr", "b.period=1999"))


@check("a3_cohort_jevons", with_(*TWO) + f"select {ELEMENTARY_COLUMNS} from elem where period=2000")
def a3(spark, sf):
    return elementary.jevons_of_two(*two_years(spark, sf))


@check("j1_match_flights", with_(*TWO) + "select c.sector,c.carrier_code,c.advance_days,c.flight_number flight,c.k occurrence,b.fare base_fare,c.fare current_fare from num c join num b on b.period=1999 and c.period=2000 and b.sector=c.sector and b.carrier_code=c.carrier_code and b.advance_days=c.advance_days and b.flight_number=c.flight_number and b.departure_time=c.departure_time and b.k=c.k")
def j1(spark, sf):
    return elementary.match_flights(*two_years(spark, sf)).select("sector", "carrier_code", "advance_days", "flight", "occurrence", "base_fare", "current_fare")


@check("w1_occurrence_no", with_(*O.USE, *O.elementary("usable", "year(travel_date)", "b.period=1995")[:1]) + "select period yr,sector,flight_number flight,fare,k occurrence from num")
def w1(spark, sf):
    usable = tables.usable_facts(spark, sf).withColumn("yr", F.year("travel_date"))
    rows = elementary.prepare(usable, "yr", "total_fare", ["travel_date", "quote_id"])
    return elementary.number_quotes(rows, ["yr"], "travel_date", "quote_id").select("yr", "sector", "flight", "fare", "occurrence")


@check("a1_geometric_mean", with_(*O.FACT) + f"select sector,{R('exp(avg(ln(total_fare)))', 4)} geometric_mean,count(*) quotes from facts where total_fare>0 group by 1")
def a1(spark, sf):
    return tables.facts(spark, sf).groupBy("sector").agg(
        to_places(numeric.geometric_mean("total_fare"), 4).alias("geometric_mean"), F.count_if(F.col("total_fare") > 0).alias("quotes"))


@check("a2_jevons", with_(*O.FACT) + f"select sector,{R('exp(avg(ln(total_fare)) filter (year(travel_date)=2000)-avg(ln(total_fare)) filter (year(travel_date)=1999))', 6)} jevons from facts where total_fare>0 group by 1")
def a2(spark, sf):
    def mean_log(year: int) -> Column:
        return F.avg(F.when((F.year("travel_date") == year) & (F.col("total_fare") > 0), F.ln("total_fare")))
    return tables.facts(spark, sf).groupBy("sector").agg(to_places(elementary.jevons(mean_log(1999), mean_log(2000)), 6).alias("jevons"))


def _pair_of(sql: str) -> str:
    return with_(*TWO) + f"select sector,carrier_code,advance_days from ({sql})"


@check("u1_cohort_union", _pair_of("select distinct sector,carrier_code,advance_days from usable_y"))
def u1(spark, sf):
    return elementary.cohort_keys(*two_years(spark, sf))


@check("j5_u3_active_cohorts", _pair_of("select distinct sector,carrier_code,advance_days from usable_y where yr=1999 intersect select distinct sector,carrier_code,advance_days from usable_y where yr=2000"))
def j5(spark, sf):
    return elementary.active_keys(*two_years(spark, sf))


@check("a5_tornqvist", with_(*TWO) + f"select sector,{R('exp(sum(base_quote_count*ln(index_value))/sum(base_quote_count)/2+sum(current_quote_count*ln(index_value))/sum(current_quote_count)/2)', 6)} index_value from elem where period=2000 group by 1")
def a5(spark, sf):
    elem = elementary.jevons_of_two(*two_years(spark, sf))
    value = route.tornqvist(F.ln("index_value"), F.col("base_quote_count"), F.col("current_quote_count"))
    return elem.groupBy("sector").agg(to_places(value, 6).alias("index_value"))


_W = O.case("carrier_code", C.CARRIER_SHARES, "0.05")


@check("a6_route_tornqvist", with_(*TWO) + f"""select sector,advance_days,string_agg(carrier_code,',' order by carrier_code) active_carriers,{R('exp(sum(w*ln(index_value))/sum(w))', 6)} index_value,count(*)=1 is_monopoly,
 array_to_string(list_filter({O.items(C.CARRIER_CODES)},lambda x: not list_contains(list(carrier_code),x)),',') missing_carriers from (select *,{_W} w from elem where period=2000) group by 1,2""")
def a6(spark, sf):
    cells = route.route_indices(elementary.jevons_of_two(*two_years(spark, sf)))
    return cells.select("sector", "advance_days", F.concat_ws(",", "active_carriers").alias("active_carriers"), "index_value", "is_monopoly",
                        F.concat_ws(",", "missing_carriers").alias("missing_carriers"))


@check("a6_carrier_weights", with_(*TWO) + f"select sector,advance_days,carrier_code,{R('w/sum(w) over (partition by sector,advance_days)', 6)} weight_base,index_value from (select *,{_W} w from elem where period=2000)")
def a6_weights(spark, sf):
    cells = route.route_indices(elementary.jevons_of_two(*two_years(spark, sf)))
    return route.carrier_weights(cells).select("sector", "advance_days", "carrier_code", "weight_base", "index_value")


@check("a7_route_indices", with_(*O.YEARLY) + "select period yr,sector,advance_days,index_value,carriers from route")
def a7(spark, sf):
    return yearly_routes(spark, sf)


GAP = "sector='DEL-BOM' and carrier_code='6E'"
GAPPED = (*O.USE, f"usable_y as ({LABELS} and not ({GAP}))",
          *O.elementary("usable_y", "yr", "b.period=1999"))


@check("j6_missing_carriers", with_(*GAPPED) + f"select c.sector,c.advance_days,k carrier_code from (select distinct sector,advance_days from elem where period=2000) c,unnest({O.items(C.CARRIER_CODES)}) u(k) where not exists (select 1 from elem e where e.period=2000 and e.sector=c.sector and e.advance_days=c.advance_days and e.carrier_code=k)")
def j6(spark, sf):
    """One carrier leaves one sector, so its cells lack it."""
    return route.missing_carriers(elementary.jevons_of_two(*[df.filter(~F.expr(GAP)) for df in two_years(spark, sf)]))


@check("u2_known_or_seen", with_(*TWO) + f"select distinct sector,advance_days,k carrier_code from elem,unnest({O.items(C.CARRIER_CODES)}) u(k) where period=2000")
def u2(spark, sf):
    return route.known_or_seen(elementary.jevons_of_two(*two_years(spark, sf)))


@check("a8_j4_weight_matrix", with_(*O.USE) + f"""select sector,advance_days,{O.case('sector', C.SECTOR_TIERS)} route_tier,{R('s.w/sum(s.w) over (partition by advance_days)*d.w/sum(d.w) over (partition by sector)', 9)} omega
 from (select sector,count(*) w from usable group by 1) s,(select advance_days,count(*) w from usable group by 1) d""")
def a8(spark, sf):
    usable = tables.usable_facts(spark, sf)

    def counted(key: str) -> DataFrame:
        return usable.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return national.omega_grid(national.with_tier(counted("sector")), counted("advance_days")).withColumn("omega", to_places("omega", 9))


@check("a9_national_laspeyres", with_(*O.YEARLY) + "select period yr,composite_index,composite_relative,total_observed_weight,is_fully_observed,missing_cells_count from nat")
def a9(spark, sf):
    return yearly(spark, sf)


_PART = R("sum(omega*index_value*100)*case when max(n)<150 then 1/max(w) else 1.0::double end", 6)
_LEVEL = R("sum(omega*index_value*100)/sum(omega)", 6)


@check("a10_contributions", with_(*O.YEARLY) + " union all ".join(
    f"select period yr,'{d}' dimension,{m} member,{_PART} contribution,{_LEVEL} \"level\",{R('sum(omega)', 7)} observed_weight from obs join nat0 using (period) group by 1,2,3"
    for d, m in (("sector", "sector"), ("window", "'T+'||advance_days"), ("tier", "route_tier"), ("all", "'NATIONAL'"))))
def a10(spark, sf):
    return national.contributions(yearly_routes(spark, sf), national.default_omega(spark), ["yr"]).drop("cells")


@check("j3_attach_cells", with_(*O.YEARLY) + "select p.period yr,o.sector,o.advance_days,o.route_tier,r.index_value from (select distinct period from route) p cross join omega o left join route r on r.period=p.period and r.sector=o.sector and r.advance_days=o.advance_days")
def j3(spark, sf):
    return national.attach_cells(yearly_routes(spark, sf), national.default_omega(spark), ["yr"]).select("yr", "sector", "advance_days", "route_tier", "index_value")


@check("u4_missing_cells", with_(*O.DAILY) + "select cast(p.period as varchar) travel_date,count(*) missing from (select distinct period from route) p cross join omega o left join route r on r.period=p.period and r.sector=o.sector and r.advance_days=o.advance_days where r.index_value is null group by 1")
def u4(spark, sf):
    cells = publish.route_relatives(tables.usable_facts(spark, sf))
    missing = national.missing_cells(cells, national.default_omega(spark), ["travel_date"])
    return missing.groupBy("travel_date").agg(F.count(F.lit(1)).alias("missing")).select(day("travel_date"), "missing")


@check("j16_sector_tier", with_(*O.FACT) + f"select sector,{O.case('sector', C.SECTOR_TIERS, chr(39) + 'Trunk' + chr(39))} route_tier,count(*) n from facts group by sector")
def j16(spark, sf):
    return national.with_tier(tables.facts(spark, sf).groupBy("sector").agg(F.count(F.lit(1)).alias("n")))


# --- joins ---------------------------------------------------------------------------------

_ROUTE_ID = O.case("sector", {s: i for i, s in enumerate(C.SECTOR_CODES, 1)})
_CARRIER_ID = O.case("carrier_code", {s: i for i, s in enumerate(C.CARRIER_CODES, 1)})


@check("s9_j2_attach_dims", with_(*O.FACT) + f"select quote_id,cast({_ROUTE_ID} as int) route_id,cast({_CARRIER_ID} as int) carrier_id from facts")
def j2(spark, sf):
    return weights.attach_dims(tables.facts(spark, sf)).select("quote_id", "route_id", "carrier_id")


@check("j8_attach_tariffs", with_(*O.BASE) + f"select quote_id,coalesce({O.case('origin_iata', C.UDF_PRIMARY)},380.0::double) udf,180.0::double psf,coalesce(raw_convenience_fee,{O.case('source', C.SOURCE_FEES)},0.0::double) fee from valid")
def j8(spark, sf):
    return decompose.attach_tariffs(tables.valid_quotes(spark, sf)).select("quote_id", "udf", "psf", "fee")


@check("j8_custom_tariffs", with_(*O.BASE, "rates as (select origin_iata,count(*)/100.0::double u from valid group by 1 having count(*)>1)") + "select quote_id,coalesce(r.u,380.0::double) udf from valid left join rates r using (origin_iata)")
def j8_custom(spark, sf):
    valid = tables.valid_quotes(spark, sf)
    counts = valid.groupBy("origin_iata").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rates = counts.select(F.col("origin_iata").alias("origin"), (F.col("n") / 100.0).alias("udf"))
    return decompose.attach_tariffs(valid, udf_rates=rates).select("quote_id", "udf")


@check("j9_attach_income", with_(*O.FACT) + f"select sector,any_value({O.case('origin_iata', C.INCOMES, '250000.0::double')}) income_origin,any_value({O.case('destination_iata', C.INCOMES, '250000.0::double')}) income_destination from facts group by 1")
def j9(spark, sf):
    routes = tables.facts(spark, sf).select("sector", "origin_iata", "destination_iata").distinct()
    return analytics.attach_income(routes).select("sector", "income_origin", "income_destination")


@check("j10_attach_coords", with_(*O.FACT) + f"select sector,any_value({O.case('origin_iata', {a[0]: a[1] for a in C.AIRPORTS})}) origin_city,any_value({O.case('destination_iata', {a[0]: a[2] for a in C.AIRPORTS}, '19.08::double')}) destination_lat from facts group by 1")
def j10(spark, sf):
    routes = tables.facts(spark, sf).select("sector", "origin_iata", "destination_iata").distinct()
    return analytics.attach_coords(routes).select("sector", "origin_city", "destination_lat")


_SERIES = """ser as (select travel_date d,carrier_code,avg(total_fare) v from usable group by 1,2),
al as (select a.d,a.v actual,p.v predicted,o.v other from ser a join ser p on p.d=a.d and p.carrier_code='AI' join ser o on o.d=a.d and o.carrier_code='IX' where a.carrier_code='6E')"""


def carrier_day(spark: SparkSession, sf: str) -> DataFrame:
    return tables.usable_facts(spark, sf).groupBy(F.col("travel_date").alias("date"), "carrier_code").agg(F.avg("total_fare").alias("value"))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    days = carrier_day(spark, sf)
    parts = [days.filter(F.col("carrier_code") == c).select("date", F.col("value").alias(n)) for c, n in (("6E", "actual"), ("AI", "predicted"), ("IX", "other"))]
    return validation.align_series(*parts).withColumn("year", F.year("date"))


@check("j11_align_series", with_(*O.USE, _SERIES) + f"select cast(d as varchar) date,{R('actual', 4)} actual,{R('predicted', 4)} predicted,{R('other', 4)} other from al")
def j11(spark, sf):
    return aligned(spark, sf).select(day("date"), *[to_places(c, 4).alias(c) for c in ("actual", "predicted", "other")])


@check("j12_offset_join", with_(*O.USE, _SERIES) + f"select cast(s.d as varchar) date,s.carrier_code,{R('p1.v', 4)} prev_1,{R('p7.v', 4)} prev_7,{R('p30.v', 4)} prev_30 from ser s left join ser p1 on p1.carrier_code=s.carrier_code and p1.d=s.d-1 left join ser p7 on p7.carrier_code=s.carrier_code and p7.d=s.d-7 left join ser p30 on p30.carrier_code=s.carrier_code and p30.d=s.d-30")
def j12(spark, sf):
    offsets = {"prev_1": 1, "prev_7": 7, "prev_30": 30}
    return movements.offset_join(carrier_day(spark, sf), offsets, ["carrier_code"]).select(
        day("date"), "carrier_code", *[to_places(c, 4).alias(c) for c in offsets])


@check("j13_undirected_lookup", with_(*O.FACT, "sp as (select sector,count(*) distance_km from facts where substr(sector,1,3)<substr(sector,5,3) group by 1)") + "select f.sector,coalesce(a.distance_km,b.distance_km,1000) distance_km,count(*) n from facts f left join sp a on a.sector=f.sector left join sp b on b.sector=substr(f.sector,5,3)||'-'||substr(f.sector,1,3) group by 1,2")
def j13(spark, sf):
    facts = tables.facts(spark, sf)
    counts = facts.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    one_way = counts.filter(F.substring("sector", 1, 3) < F.substring("sector", 5, 3)).withColumnRenamed("n", "distance_km")
    return analytics.undirected_lookup(counts, one_way, "distance_km", 1000)


@check("j14_in_basket", with_(*O.FACT) + f"select quote_id,sector from facts where sector in ({O.quoted(C.SECTOR_CODES)})")
def j14(spark, sf):
    return analytics.in_basket(tables.facts(spark, sf), weights.dim_routes(spark)).select("quote_id", "sector")


_GRID = f"""grid as (select s.sector,w advance_days,c carrier_code,src source from (select distinct sector from facts) s,unnest({O.items(C.WINDOWS)}) a(w),unnest({O.items(C.CARRIER_CODES)}) b(c),
 unnest(list_concat([{O.case('c', {r[0]: r[4] for r in C.CARRIERS})}],{O.items(C.AGENCIES)})) d(src)),
seen as (select distinct sector,advance_days,carrier_code,source from facts)"""


@check("j15_basket_fill", with_(*O.FACT, _GRID) + f"select sector,count(*) expected,count(s.source) observed,{R('count(s.source)*100.0::double/count(*)', 4)} fill_rate_pct from grid g left join seen s using (sector,advance_days,carrier_code,source) group by 1")
def j15(spark, sf):
    facts = tables.facts(spark, sf)
    return analytics.basket_fill(analytics.basket_grid(facts.select("sector").distinct()), facts)


@check("j15_basket_missing", with_(*O.FACT, _GRID) + "select sector,advance_days,carrier_code,source from grid except select * from seen")
def j15_missing(spark, sf):
    facts = tables.facts(spark, sf)
    return analytics.basket_missing(analytics.basket_grid(facts.select("sector").distinct()), facts)


# --- aggregates -------------------------------------------------------------------------------

@check("a13_a14_cohort_stats", with_(*O.BASE, O.DEDUP, O.COHORT) + f"select sector,advance_days,weekday,any_value(cohort_size) cohort_size,{R('any_value(cohort_median)', 4)} cohort_median,{R('any_value(lower_bound)', 4)} lower_bound,{R('any_value(upper_bound)', 4)} upper_bound from co group by 1,2,3")
def a13(spark, sf):
    rows = quality.with_cohort(dedup.deduplicate_quotes(tables.valid_quotes(spark, sf)))
    return quality.cohort_stats(rows).select("sector", "advance_days", "weekday", "cohort_size", *[
        to_places(c, 4).alias(c) for c in ("cohort_median", "lower_bound", "upper_bound")])


@check("w4_cohort_frame", with_(*O.BASE, O.DEDUP, O.COHORT) + f"select quote_id,cohort_size,{R('cohort_median', 4)} cohort_median from co")
def w4(spark, sf):
    return cohort_rows(spark, sf).select("quote_id", "cohort_size", to_places("cohort_median", 4).alias("cohort_median"))


_ITEMS = "itm as (select source,sector||'|'||advance_days item,avg(total_fare) fare from usable group by 1,2),rk as (select *,rank() over (partition by source order by fare) rank from itm)"


def source_items(spark: SparkSession, sf: str) -> DataFrame:
    return tables.usable_facts(spark, sf).groupBy("source", F.concat_ws("|", "sector", "advance_days").alias("item")).agg(F.avg("total_fare").alias("fare"))


@check("w13_rank_within_source", with_(*O.USE, _ITEMS) + f"select source,item,{R('fare', 4)} fare,rank from rk")
def w13(spark, sf):
    return screening.rank_within_source(source_items(spark, sf)).select("source", "item", to_places("fare", 4).alias("fare"), "rank")


@check("a15_kendall_w", with_(*O.USE, _ITEMS) + f"select {R('least(1.0::double,greatest(0.0::double,12*var_pop(r)*count(*)/(max(m)*max(m)*(pow(count(*),3)-count(*)))))', 6)} kendall_w,max(m) sources,count(*) items from (select item,sum(rank)::double r,count(*)::double m from rk group by 1)")
def a15(spark, sf):
    w = screening.kendall_w(screening.rank_within_source(source_items(spark, sf)))
    return w.select(to_places("kendall_w", 6).alias("kendall_w"), F.col("sources").cast("double"), "items")


_MAD = """ck as (select * from facts where total_fare>0),
m1 as (select sector,advance_days,quantile_cont(total_fare,0.5) md,avg(total_fare) mean,stddev_pop(total_fare) sd from ck group by 1,2 having count(*)>=3),
m2 as (select sector,advance_days,quantile_cont(abs(total_fare-md),0.5) mad0 from ck join m1 using (sector,advance_days) group by 1,2),
an as (select *,greatest(abs(0.6745::double*(total_fare-md)/mad),abs(case when sd>0 then (total_fare-mean)/sd else 0 end)) z from (select *,case when mad0<1e-4 then case when sd>1e-4 then sd/1.4826 else 1 end else mad0 end mad from ck join m1 using (sector,advance_days) join m2 using (sector,advance_days))),
fg as (select *,case when z>=4 or total_fare>20000 then 'critical' when z>=3 then 'high' else 'medium' end severity,case when total_fare>md then 'price_surge' else 'predatory_pricing' end anomaly_type from an where z>=3 or total_fare>15000 or total_fare>2.5*md)"""
_MAD_SELECT = f"select quote_id,severity,anomaly_type,{R('total_fare', 2)} observed_fare,{R('greatest(999,md-2.5*mad)', 2)} expected_low,{R('least(35000,md+2.5*mad)', 2)} expected_high,{R('z', 2)} z_score,case when z>=3.5 then '{screening.ACTION_INQUIRY}' else '{screening.ACTION_REVIEW}' end recommended_action from fg"
_MAD_COLUMNS = ["quote_id", "severity", "anomaly_type", "observed_fare", "expected_low", "expected_high", "z_score", "recommended_action"]


@check("a16_mad_anomalies", with_(*O.FACT, _MAD) + _MAD_SELECT)
def a16(spark, sf):
    return screening.mad_anomalies(tables.facts(spark, sf).select("quote_id", "sector", "advance_days", "total_fare")).select(*_MAD_COLUMNS)


@check("p13_filter_anomalies", with_(*O.FACT, _MAD) + _MAD_SELECT + " where severity='critical' and anomaly_type='price_surge'")
def p13(spark, sf):
    found = screening.mad_anomalies(tables.facts(spark, sf).select("quote_id", "sector", "advance_days", "total_fare"))
    return screening.filter_anomalies(found, "CRITICAL", "Price_Surge").select(*_MAD_COLUMNS)


@check("a17_route_summary", with_(*O.FACT) + f"select sector,carrier_code,count(*) \"count\",{R('avg(total_fare)', 2)} avg_fare,{R('min(total_fare)', 2)} min_fare,{R('max(total_fare)', 2)} max_fare from facts where data_quality_score>=80 and not is_outlier group by 1,2")
def a17(spark, sf):
    return analytics.route_summary(tables.facts(spark, sf))


_MONTHS = f"lv0 as (select carrier_code series_id,date_trunc('month',travel_date)::date m,count(*) n,{R('avg(total_fare)/4800*100', 4)} lvl from usable group by 1,2),lv as (select *,row_number() over (partition by series_id order by m)-1 idx from lv0 where n>=10)"


def carrier_months(spark: SparkSession, sf: str) -> DataFrame:
    levels = movements.monthly_level(tables.usable_facts(spark, sf), ["carrier_code"]).filter(F.col("level").isNotNull())
    return levels.select(F.col("carrier_code").alias("series_id"), "month", "level")


@check("a18_monthly_level", with_(*O.USE, _MONTHS) + "select series_id carrier_code,cast(m as varchar) \"month\",n quotes,case when n>=10 then lvl end \"level\" from lv0")
def a18(spark, sf):
    return movements.monthly_level(tables.usable_facts(spark, sf), ["carrier_code"]).select("carrier_code", day("month"), "quotes", "level")


@check("a20_fit_measures", with_(*O.USE, _SERIES) + f"select year(d) \"year\",{R('1-sum((actual-predicted)*(actual-predicted))/(var_pop(actual)*count(*))', 4)} r_squared,{R('avg(abs((predicted-actual)/actual))*100', 4)} mape,{R('sqrt(avg((predicted-actual)*(predicted-actual)))', 4)} rmse from al group by 1 having count(*)>1")
def a20(spark, sf):
    a, p = F.col("actual"), F.col("predicted")
    return aligned(spark, sf).groupBy("year").agg(
        to_places(validation.r_squared(a, p), 4).alias("r_squared"), to_places(validation.mape(a, p), 4).alias("mape"),
        to_places(validation.rmse(a, p), 4).alias("rmse"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


@check("a21_fare_stats", with_(*O.FACT) + f"select count(*) total_quotes,count(distinct sector) monitored_routes,count(distinct carrier_code) monitored_carriers,{R('avg(total_fare)', 2)} average_fare,min(total_fare) min_fare,max(total_fare) max_fare,{R('avg(data_quality_score)', 2)} average_dqs from facts")
def a21(spark, sf):
    return analytics.fare_stats(tables.facts(spark, sf))


@check("a22_fill_rate", with_(*O.BASE) + f"select source,{R('avg(case when raw_total_fare>0 then 1.0::double else 0.0::double end)*100', 4)} fill_rate_pct from norm group by 1")
def a22(spark, sf):
    return tables.normalized_quotes(spark, sf).groupBy("source").agg(to_places(validation.fill_rate(F.col("raw_total_fare")), 4).alias("fill_rate_pct"))


_BACK = f"""bt as (select *,sign(predicted-lag(predicted) over (partition by year(d) order by d))=sign(other-lag(other) over (partition by year(d) order by d)) same from al),
bm as (select year(d) y,count(*) as days,1-sum((actual-predicted)*(actual-predicted))/(var_pop(actual)*count(*)) r2,avg(abs((predicted-actual)/actual))*100 mape,sqrt(avg((predicted-actual)*(predicted-actual))) rmse,avg(case when same is not null then cast(same as int)::double end)*100 conc,avg(case when predicted>0 then 1.0::double else 0 end)*100 fill from bt group by 1 having count(*)>1)"""


@check("a23_a32_backtest_metrics", with_(*O.USE, _SERIES, _BACK) + f"select y \"year\",days,{R('r2', 4)} r_squared,{R('mape', 2)} mape_pct,{R('rmse', 2)} rmse,{R('conc', 1)} directional_concordance_pct,{R('fill', 1)} data_fill_rate_pct,case when r2>0.85 and mape<15 and conc>=80 and fill>=95 then 'PASSED' else 'FAILED' end verdict from bm")
def a23(spark, sf):
    return validation.backtest_metrics(aligned(spark, sf), ["year"]).filter("days > 1").select(
        "year", "days", "r_squared", "mape_pct", "rmse", "directional_concordance_pct", "data_fill_rate_pct", "verdict")


@check("a32_residual_table", with_(*O.USE, _SERIES) + f"select cast(d as varchar) date,{R('predicted', 2)} predicted_fare,{R('actual', 2)} actual_fare,{R('predicted-actual', 2)} residual,{R('abs(predicted-actual)/actual*100', 2)} pct_error,{R('other', 3)} benchmark from al")
def a32(spark, sf):
    return validation.residual_table(aligned(spark, sf)).withColumn("date", F.col("date").cast("string"))


@check("w8_directional_concordance", with_(*O.USE, _SERIES, _BACK) + f"select y \"year\",{R('conc', 4)} directional_concordance_pct from bm")
def w8(spark, sf):
    found = validation.directional_concordance(aligned(spark, sf), "predicted", "other", ["year"])
    return found.filter(F.col("directional_concordance_pct").isNotNull()).withColumn("directional_concordance_pct", to_places("directional_concordance_pct", 4))


_CURVE = "cv as (select sector,advance_days,avg(total_fare) fare,count(*) quotes from facts group by 1,2)"
_AT = "max(fare) filter (advance_days={})"


@check("a24_lead_time_curve", with_(*O.FACT, _CURVE) + f"select sector,advance_days,{R('fare', 2)} fare,quotes,{R('fare/max(fare) filter (advance_days=45) over (partition by sector)*100', 4)} relative_index from cv")
def a24(spark, sf):
    return analytics.lead_time_curve(tables.facts(spark, sf)).withColumns({"fare": to_places("fare", 2), "relative_index": to_places("relative_index", 4)})


@check("a24_elasticity", with_(*O.FACT, _CURVE) + f"select sector,{R(_AT.format(1) + '/' + _AT.format(45), 4)} t1_to_t45_ratio,{R('(' + _AT.format(1) + '/' + _AT.format(7) + '-1)*100', 4)} last_week_surge_pct,{R('regr_slope(ln(fare),advance_days)', 6)} exponential_decay_rate from cv group by 1")
def a24_measures(spark, sf):
    return analytics.elasticity(tables.facts(spark, sf))


@check("a25_carrier_comparison", with_(*O.FACT) + f"select sector,carrier_code,{O.case('carrier_code', {r[0]: r[1] for r in C.CARRIERS})} carrier_name,{_W} market_share,{R('avg(total_fare)', 2)} average_fare,count(*) quotes,{R('count(*)*100.0::double/sum(count(*)) over (partition by sector)', 4)} quote_share_pct from facts group by sector,carrier_code")
def a25(spark, sf):
    return analytics.carrier_comparison(tables.facts(spark, sf))


@check("a26_best_booking_window", with_(*O.FACT, _CURVE) + f"select sector,'T+'||arg_min(advance_days,fare) recommended_window,{R('(1-min(fare)/avg(fare))*100', 2)} average_saving_pct,{R('(' + _AT.format(1) + '/min(fare)-1)*100', 2)} last_minute_penalty_pct from cv group by 1")
def a26(spark, sf):
    return analytics.best_booking_window(tables.facts(spark, sf))


@check("a27_route_detail", with_(*TWO, O.routes(), "cv as (select sector,advance_days,avg(total_fare) fare from usable group by 1,2)") + f"""select sector,cast({O.case('sector', {k: v[0] for k, v in C.SECTOR_SPECS.items()})} as int) distance_km,{O.case('sector', C.SECTOR_TIERS)} route_tier,r.advance_days,{R('r.index_value*100', 2)} "index",{R('fare', 2)} average_fare,(select count(distinct carrier_code) from usable u where u.sector=r.sector) carriers
 from route r left join cv using (sector,advance_days) where period=2000""")
def a27(spark, sf):
    cells = route.route_indices(elementary.jevons_of_two(*two_years(spark, sf)), details=False)
    detail = analytics.route_detail(cells, tables.usable_facts(spark, sf))
    return detail.select("sector", "distance_km", "route_tier", F.size("carrier_shares").cast("bigint").alias("carriers"), F.inline("advance_windows"))


@check("a30_basket_counts", with_(*O.FACT) + "select sector,advance_days,source,count(*) quotes from facts group by rollup(sector,advance_days,source)")
def a30(spark, sf):
    return analytics.basket_counts(tables.facts(spark, sf)).drop("level")


# --- multilateral ----------------------------------------------------------------------------------

_YEARS = "yl0 as (select carrier_code series_id,year(travel_date) p,avg(total_fare) lvl from usable group by 1,2),yl as (select *,row_number() over (partition by series_id order by p)-1 idx from yl0)"


def carrier_years(spark: SparkSession, sf: str) -> DataFrame:
    return tables.usable_facts(spark, sf).groupBy(F.col("carrier_code").alias("series_id"), F.year("travel_date").alias("period")).agg(F.avg("total_fare").alias("level"))


@check("j7_bilateral_pairs", with_(*O.USE, _YEARS) + f"select a.series_id,a.p p_from,b.p p_to,{R('b.lvl/a.lvl', 6)} rel from yl a join yl b on a.series_id=b.series_id and abs(a.idx-b.idx)<3")
def j7(spark, sf):
    return multilateral.bilateral_pairs(carrier_years(spark, sf), 3).select("series_id", "p_from", "p_to", to_places("rel", 6).alias("rel"))


_COHORT_YEARS = """cy as (select carrier_code series_id,sector,advance_days,year(travel_date) p,avg(ln(total_fare)) lg from usable group by 1,2,3,4),
yr as (select p,row_number() over (order by p)-1 idx from (select distinct p from cy)),
bl as (select a.series_id,a.p p_from,b.p p_to,ya.idx i,yb.idx j,exp(sum(omega*(b.lg-a.lg))/sum(omega)) rel from cy a join cy b on a.series_id=b.series_id and a.sector=b.sector and a.advance_days=b.advance_days join omega o on o.sector=a.sector and o.advance_days=a.advance_days join yr ya on ya.p=a.p join yr yb on yb.p=b.p group by 1,2,3,4,5)"""


def cohort_years(spark: SparkSession, sf: str) -> DataFrame:
    usable = tables.usable_facts(spark, sf).filter(F.col("total_fare") > 0)
    cells = usable.groupBy(F.col("carrier_code").alias("series_id"), "sector", "advance_days", F.year("travel_date").alias("period")).agg(F.avg(F.ln("total_fare")).alias("log_mean"))
    return cells.withColumn("idx", F.col("period") - F.min("period").over(Window.partitionBy("series_id")))


def true_bilateral(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted Törnqvist-style relatives between all year pairs, completed with inverses."""
    omega = national.default_omega(spark).select("sector", "advance_days", F.col("omega").alias("weight"))
    span = cohort_years(spark, sf).agg(F.max("idx")).first()[0] or 0  # one number: how far apart years can be
    forward = multilateral.bilateral_from_cohorts(cohort_years(spark, sf), omega, span + 1, ["sector", "advance_days"])
    back = forward.select("series_id", F.col("p_to").alias("p_from"), F.col("p_from").alias("p_to"), F.col("j").alias("i"), F.col("i").alias("j"), (1.0 / F.col("rel")).alias("rel"))
    years = cohort_years(spark, sf).select("series_id", "period", "idx").distinct()
    same = years.select("series_id", F.col("period").alias("p_from"), F.col("period").alias("p_to"), F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("rel"))
    return forward.unionByName(back).unionByName(same)


@check("j7_cohort_relatives", with_(*O.USE, O.OMEGA, _COHORT_YEARS) + f"select series_id,p_from,p_to,{R('rel', 6)} rel from bl")
def j7_cohort(spark, sf):
    return true_bilateral(spark, sf).select("series_id", "p_from", "p_to", to_places("rel", 6).alias("rel"))


@check("a11_geks_vector", with_(*O.USE, O.OMEGA, _COHORT_YEARS) + f"select series_id,p_to \"period\",{R('exp(m-first(m) over (partition by series_id order by p_to))', 6)} geks from (select series_id,p_to,avg(ln(rel)) m from bl group by 1,2)")
def a11(spark, sf):
    return multilateral.geks_vector(true_bilateral(spark, sf)).select("series_id", "period", to_places("geks", 6).alias("geks"))


@check("a12_geks_pairwise", with_(*O.USE, O.OMEGA, _COHORT_YEARS) + f"select series_id,{R('exp(avg(ln(rel)) filter (p_to=2000)-avg(ln(rel)) filter (p_to=1996))', 6)} geks from bl group by 1")
def a12(spark, sf):
    return multilateral.geks_pairwise(true_bilateral(spark, sf), 1996, 2000).select("series_id", to_places("geks", 6).alias("geks"))


@check("d11_chain_drift", with_(*O.USE, O.OMEGA, _COHORT_YEARS) + f"""select c.series_id,{R('c.ch', 6)} chained,{R('g.gk', 6)} geks from (select series_id,exp(sum(ln(rel))) ch from bl where j=i+1 group by 1) c
 join (select series_id,exp(arg_max(m,j)-arg_min(m,j)) gk from (select series_id,j,avg(ln(rel)) m from bl group by 1,2) group by 1) g using (series_id)""")
def d11(spark, sf):
    return multilateral.chain_drift(true_bilateral(spark, sf)).select("series_id", to_places("chained", 6).alias("chained"), to_places("geks", 6).alias("geks"))


def _fold_sql(method: str) -> str:
    f = "greatest(0,t-12)"
    g = f"(arr[t+1]/arr[{f}+1])"
    mean = f"list_avg(list_transform(range({f},t),lambda j: ln(pub[j+1])-ln(arr[j+1]/arr[{f}+1])))"
    value = {"mean": f"{g}*exp({mean})", "movement": "pub[t]*arr[t+1]/arr[t]", "window": f"pub[{f}+1]*{g}",
             "half": f"sqrt((pub[t]*arr[t+1]/arr[t])*(pub[{f}+1]*{g}))"}[method]
    return f"""fold_{method} as (select series_id,arr,1 t,[100.0::double] pub from ar union all
 select series_id,arr,t+1,list_append(pub,{R(value, 4)}) from fold_{method} where t<len(arr))"""


_ARRAYS = "ar as (select series_id,list(lvl order by idx) arr from lv group by 1)"
_METHODS = ("mean", "movement", "window", "half")


def _published_sql(method: str) -> str:
    return f"select f.series_id,cast(lv.m as varchar) \"month\",f.pub[lv.idx+1] published_index,'{method}' \"method\",least(lv.idx+1,13) window_length,lv.idx+1<13 is_expanding_window from fold_{method} f join lv on lv.series_id=f.series_id where f.t=len(f.arr)"


def _published(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return multilateral.rygeks_series(carrier_months(spark, sf), method=method, period="month").select(
        "series_id", day("month"), "published_index", F.lit(method).alias("method"), "window_length", "is_expanding_window")


for _method in _METHODS:
    check(f"w6_w12_rygeks_{_method}", "with recursive " + ",\n".join((*O.USE, _MONTHS, _ARRAYS, _fold_sql(_method))) + "\n" + _published_sql(_method))(
        lambda spark, sf, method=_method: _published(spark, sf, method))


@check("w5_rolling_geks", with_(*O.USE, _MONTHS) + f"select a.series_id,b.idx t,a.idx-greatest(0,b.idx-12) pos,{R('a.lvl/f.lvl', 6)} g from lv b join lv a on a.series_id=b.series_id and a.idx between greatest(0,b.idx-12) and b.idx join lv f on f.series_id=b.series_id and f.idx=greatest(0,b.idx-12)")
def w5(spark, sf):
    numbered = multilateral.number_periods(carrier_months(spark, sf), period="month")
    pairs = multilateral.bilateral_pairs(carrier_months(spark, sf), 14, period="month")
    rolled = multilateral.rolling_geks(numbered, pairs, 13)
    return rolled.select("series_id", "t", F.posexplode("g").alias("pos", "value")).select("series_id", "t", "pos", to_places("value", 6).alias("g"))


# --- publications ----------------------------------------------------------------------------------

def _move(now: str, before: str) -> str:
    return f"case when {before}>0 then {R(f'({now}/{before}-1.0::double)*100', 2)} when {before} is not null then 0.0::double end"


_DAILY_PARTS = f"""tp as (select period,""" + ",".join(
    f"{R(f'sum(omega*index_value*100) filter (route_tier=$${t}$$)*case when count(*)<150 then 1/sum(omega) else 1.0::double end', 6)} {n}" for t, n in publish.TIERS.items()) + "," + ",".join(
    f"{R(f'sum(omega*index_value*100) filter (advance_days={w})*case when count(*)<150 then 1/sum(omega) else 1.0::double end', 6)} window_{w}" for w in C.WINDOWS) + " from obs group by 1)"


def _held(name: str) -> str:
    return f"case when d.composite_index is not null then {R(name, 2)} end {name}"


@check("w14_daily_index", with_(*O.DAILY, _DAILY_PARTS) + f"""select cast(d.period as varchar) computation_date,{R('d.composite_index', 2)} index_value,{_move('d.composite_index', 'p1.composite_index')} change_dod_pct,{_move('d.composite_index', 'p7.composite_index')} change_wow_pct,{_move('d.composite_index', 'p30.composite_index')} change_mom_pct,
 d.total_quotes,d.missing_cells_count,{','.join(_held(n) for n in publish.TIERS.values())},{','.join(_held(f'window_{w}') for w in C.WINDOWS)} from daily d left join tp using (period)
 left join daily p1 on p1.period=d.period-1 left join daily p7 on p7.period=d.period-7 left join daily p30 on p30.period=d.period-30""")
def w14(spark, sf):
    return publish.daily_index(tables.usable_facts(spark, sf), national.default_omega(spark)).withColumn(
        "computation_date", F.col("computation_date").cast("string")).drop("frequency")


@check("w14_sector_index", with_(*O.YEARLY) + f"select period yr,sector,{_PART} contribution,{_LEVEL} \"level\" from obs join nat0 using (period) group by 1,2")
def w14_sectors(spark, sf):
    return publish.daily_sector_index(yearly_routes(spark, sf), national.default_omega(spark), ["yr"])


def daily_composite(spark: SparkSession, sf: str) -> DataFrame:
    return publish.daily_values(tables.usable_facts(spark, sf), national.default_omega(spark)).withColumn("series_id", F.lit("NATIONAL"))


_WEEK = "wk as (select period d,avg(composite_index) over (order by period range between interval 6 days preceding and current row) w,count(composite_index) over (order by period range between interval 6 days preceding and current row) n from daily)"


@check("a19_w7_weekly_index", with_(*O.DAILY, _WEEK) + f"select cast(k.d as varchar) travel_date,{R('k.w', 2)} weekly_value,k.n days_observed,{_move('k.w', 'p.w')} change_wow_pct from wk k left join wk p on p.d=k.d-7")
def a19(spark, sf):
    return publish.weekly_index(daily_composite(spark, sf)).select(
        day("travel_date"), to_places("weekly_value", 2).alias("weekly_value"), "days_observed", "change_wow_pct")


@check("w10_daily_changes", with_(*O.DAILY) + f"select cast(d.period as varchar) travel_date,d.composite_index,{_move('d.composite_index', 'p1.composite_index')} change_dod_pct,{_move('d.composite_index', 'p7.composite_index')} change_wow_pct,{_move('d.composite_index', 'p30.composite_index')} change_mom_pct from daily d left join daily p1 on p1.period=d.period-1 left join daily p7 on p7.period=d.period-7 left join daily p30 on p30.period=d.period-30")
def w10(spark, sf):
    moved = movements.daily_changes(daily_composite(spark, sf), ["series_id"], "travel_date", "composite_index")
    return moved.select(day("travel_date"), "composite_index", "change_dod_pct", "change_wow_pct", "change_mom_pct")


@check("w11_history_with_band", with_(*O.DAILY, O.CPI, "bm as (select date_trunc('month',strptime(\"year\"||\"month\",'%Y%B'))::date m,avg(index_value) b from cpi where code='07' group by 1)") + f"select cast(d.period as varchar) travel_date,{R('composite_index', 2)} composite,{R('composite_index-1.4::double', 2)} lower_confidence_95,{R('composite_index+1.4::double', 2)} upper_confidence_95,{R('b', 4)} transport_benchmark from daily d left join bm on bm.m=date_trunc('month',d.period)::date")
def w11(spark, sf):
    records = cpi.cpi_select(cpi_records(spark, sf), "transport").filter(F.col("code") == C.CPI_TRANSPORT_CODE)
    months = records.groupBy(F.to_date(F.concat("year", "month"), "yyyyMMMM").alias("month")).agg(F.avg("index_value").alias("index_value"))
    out = movements.history_with_band(daily_composite(spark, sf), months, date="travel_date", value="composite_index")
    return out.select(day("travel_date"), "composite", "lower_confidence_95", "upper_confidence_95", to_places("transport_benchmark", 4).alias("transport_benchmark"))


_MONTH_SERIES = f"lv as (select 'NATIONAL' series_id,m,lvl,row_number() over (order by m)-1 idx from (select date_trunc('month',travel_date)::date m,count(*) n,{R('avg(total_fare)/4800*100', 4)} lvl from usable group by 1) where n>=10)"


@check("w15_monthly_index", "with recursive " + ",\n".join((*O.USE, _MONTH_SERIES, _ARRAYS, _fold_sql("mean"), "pb as (select lv.m,f.pub[lv.idx+1] v,first(lv.m) over (order by lv.m) fm,first(f.pub[lv.idx+1]) over (order by lv.m) fv from fold_mean f join lv using (series_id) where f.t=len(f.arr))")) + f"""
select cast(a.m as varchar) "month",a.v published_index,case when a.m=a.fm then 0.0::double else {_move('a.v', 'p.v')} end change_mom_pct,case when a.m=a.fm then 0.0::double when datediff('month',a.fm,a.m)<12 then {_move('a.v', 'a.fv')} else {_move('a.v', 'y.v')} end change_yoy_pct
from pb a left join pb p on p.m=a.m-interval 1 month left join pb y on y.m=a.m-interval 12 months""")
def w15(spark, sf):
    return publish.monthly_index(tables.usable_facts(spark, sf)).select(day("month"), "published_index", "change_mom_pct", "change_yoy_pct")


_EXPORT = with_(*O.YEARLY) + f"""select period||'-01-01' date,'NATIONAL' route_id,{R('composite_index', 2)} index_value,'yearly' frequency,'Composite' tier from nat
union all select period||'-01-01',sector,{R(_LEVEL, 2)},'yearly',route_tier from obs group by period,sector,route_tier"""


def export_frame(spark: SparkSession, sf: str) -> DataFrame:
    cells, omega = yearly_routes(spark, sf), national.default_omega(spark)
    parts = national.contributions(cells, omega, ["yr"]).withColumn("date", F.make_date("yr", F.lit(1), F.lit(1)))
    top = parts.filter(F.col("dimension") == "all").select("date", to_places("contribution", 4).alias("value"))
    sectors = national.with_tier(parts.filter(F.col("dimension") == "sector").select("date", F.col("member").alias("sector"), F.col("level").alias("value")))
    return quotes.export_rows(top, sectors, "yearly")


@check("s15_export_rows", _EXPORT)
def s15(spark, sf):
    return export_frame(spark, sf)


@check("s16_export_json_rows", f"select date,route_id,index_value composite,frequency from ({_EXPORT})")
def s16(spark, sf):
    return quotes.export_json_rows(export_frame(spark, sf))


# --- sorts, limits, scalars ------------------------------------------------------------------------

_SECTOR_DAY = "sd as (select sector,travel_date d,avg(total_fare) v from usable group by 1,2)"


def sector_day(spark: SparkSession, sf: str) -> DataFrame:
    return tables.usable_facts(spark, sf).groupBy("sector", F.col("travel_date").alias("date")).agg(F.avg("total_fare").alias("value"))


_MOVES = f"mv as (select a.sector,a.d,{R('(a.v/p.v-1)*100', 2)} change_pct from sd a join sd p on p.sector=a.sector and p.d=a.d-1)"


@check("t1_a29_top_movers", with_(*O.USE, _SECTOR_DAY, _MOVES) + "select cast(d as varchar) date,sector,change_pct,case when change_pct>0 then 'up' when change_pct<0 then 'down' else 'flat' end direction,rn place from (select *,row_number() over (partition by d order by change_pct desc,sector) rn from mv) where rn<=5")
def t1(spark, sf):
    moved = movements.offset_join(sector_day(spark, sf), {"prev_1": 1}, ["sector"])
    changes = moved.select("date", "sector", numeric.pct_change(F.col("value"), F.col("prev_1")).alias("change_pct"))
    return movements.top_movers(changes, 5, per=["date"]).select(
        day("date"), "sector", "change_pct", movements.direction(F.col("change_pct")).alias("direction"), "place")


@check("t2_latest_by_sector", with_(*O.USE, _SECTOR_DAY) + f"select sector,cast(max(d) as varchar) date,{R('arg_max(v,d)', 2)} \"value\" from sd group by 1")
def t2(spark, sf):
    return movements.latest_by(sector_day(spark, sf), ["sector"]).select("sector", day("date"), to_places("value", 2).alias("value"))


@check("t3_latest_quotes", with_(*O.FACT) + "select quote_id,sector,total_fare from facts where sector='DEL-BLR' order by scrape_timestamp desc,quote_id desc limit 50")
def t3(spark, sf):
    return analytics.latest_quotes(tables.facts(spark, sf).filter(F.col("sector") == "DEL-BLR"), 50).select("quote_id", "sector", "total_fare")


@check("t5_sorted_sectors", with_(*O.FACT) + "select sector,count(*) n from facts group by 1 order by 1")
def t5(spark, sf):
    return tables.facts(spark, sf).groupBy("sector").agg(F.count(F.lit(1)).alias("n")).orderBy("sector")


@check("t6_cheapest_quote", with_(*O.FACT) + "select sector,cast(travel_date as varchar) travel_date,arg_min(quote_id,(total_fare,quote_id)) quote_id,min(total_fare) total_fare from facts group by 1,2")
def t6(spark, sf):
    return dedup.cheapest_quote(tables.facts(spark, sf), ["sector", "travel_date"]).withColumn("travel_date", F.col("travel_date").cast("string"))


@check("w2_deduplicate_quotes", with_(*O.BASE, O.DEDUP) + "select quote_id,source,raw_total_fare from dd")
def w2(spark, sf):
    return dedup.deduplicate_quotes(tables.valid_quotes(spark, sf)).select("quote_id", "source", F.col("raw_total_fare").cast("double"))


@check("w2_deduplicate_by_lead_time", with_(*O.BASE, O.DEDUP.replace("'g'),travel_date\n", "'g'),travel_date,advance_days\n")) + "select quote_id,source,advance_days from dd")
def w2_scoped(spark, sf):
    return dedup.deduplicate_quotes(tables.valid_quotes(spark, sf), scope_cols=["advance_days"]).select("quote_id", "source", "advance_days")


@check("x3_x4_dates_and_times", with_(*O.BASE) + "select quote_id,isodow(travel_date)-1 weekday,cast(last_day(travel_date) as varchar) month_end,cast(substr(departure_time,1,2) as int)*60+cast(substr(departure_time,4,2) as int) departs_minute,strftime(travel_date+cast(departure_time as time),'%Y-%m-%d %H:%M') departs_at from norm")
def x3(spark, sf):
    return tables.normalized_quotes(spark, sf).select(
        "quote_id", F.weekday("travel_date").alias("weekday"), F.last_day("travel_date").cast("string").alias("month_end"),
        text.minute_of_day("departure_time").alias("departs_minute"),
        F.date_format(text.at_time("travel_date", "departure_time"), "yyyy-MM-dd HH:mm").alias("departs_at"))


@check("x10_hashes", with_(*O.BASE) + "select quote_id,md5(concat_ws('|',quote_id,source)) row_hash,cast('0x'||substr(md5(quote_id),1,8) as bigint) hash_number from norm")
def x10(spark, sf):
    return tables.normalized_quotes(spark, sf).select("quote_id", text.row_key("quote_id", "source").alias("row_hash"), text.hash_number("quote_id").alias("hash_number"))


# --- documented extras ----------------------------------------------------------------------------

@check("d1_variance_spikes", with_(*O.FACT) + f"select a.sector,cast(a.d as varchar) travel_date,{R('a.sd', 4)} std,{R('a.cv', 6)} cv,{R('b.cv', 6)} base_cv,a.cv>2*b.cv and a.sd>2500 is_spike from (select sector,travel_date d,stddev_pop(total_fare) sd,stddev_pop(total_fare)/avg(total_fare) cv from facts group by 1,2) a join (select sector,stddev_pop(total_fare)/avg(total_fare) cv from facts group by 1) b using (sector)")
def d1(spark, sf):
    return screening.variance_spikes(tables.facts(spark, sf), ["sector"]).select(
        "sector", day("travel_date"), to_places("std", 4).alias("std"), to_places("cv", 6).alias("cv"), to_places("base_cv", 6).alias("base_cv"), "is_spike")


_SHARES = "sh as (select sector,carrier_code,count(*)*100.0::double/sum(count(*)) over (partition by sector) s from facts group by 1,2),hh as (select sector,sum(s*s) hhi from sh group by 1)"


@check("d2_hhi", with_(*O.FACT, _SHARES) + f"select sector,{R('hhi', 4)} hhi,hhi>2500 is_concentrated from hh")
def d2(spark, sf):
    return analytics.hhi(analytics.quote_shares(tables.facts(spark, sf)), ["sector"]).withColumn("hhi", to_places("hhi", 4))


def _lockstep_sql(min_jump: int) -> str:
    return with_(*O.FACT, _SHARES) + f"""select sector,advance_days,carrier_a,carrier_b,cast(hour_a as varchar) hour_a,cast(hour_b as varchar) hour_b,{R('jump_a', 4)} jump_a,{R('jump_b', 4)} jump_b from
 (with hr as materialized (select sector,advance_days,carrier_code,date_trunc('hour',scrape_timestamp) h,avg(total_fare) f from facts group by 1,2,3,4),
 jp as materialized (select *,cast(epoch(h)/3600 as bigint) hn from (select *,f-lag(f) over (partition by sector,advance_days,carrier_code order by h) j from hr) where j>{min_jump}),
 near as materialized (select *,hn+unnest(range(-4,5)) want from jp)
 select a.sector,a.advance_days,a.carrier_code carrier_a,b.carrier_code carrier_b,a.h hour_a,b.h hour_b,a.j jump_a,b.j jump_b
 from near a join jp b on a.sector=b.sector and a.advance_days=b.advance_days and a.want=b.hn where a.carrier_code<b.carrier_code and abs(a.j-b.j)<=150) join hh using (sector) where hhi>1500"""


def lockstep_rows(spark: SparkSession, sf: str, min_jump: float) -> DataFrame:
    return analytics.lockstep_moves(tables.facts(spark, sf), min_jump, hhi_limit=1500.0).select(
        "sector", "advance_days", "carrier_a", "carrier_b", F.col("hour_a").cast("string"), F.col("hour_b").cast("string"),
        to_places("jump_a", 4).alias("jump_a"), to_places("jump_b", 4).alias("jump_b"))


@check("d3_lockstep_moves", _lockstep_sql(1000))
def d3(spark, sf):
    return lockstep_rows(spark, sf, 1000.0)


@check("d3_lockstep_any_rise", _lockstep_sql(0))
def d3_any(spark, sf):
    """Rises of any size, of which small tables have some as well."""
    return lockstep_rows(spark, sf, 0.0)


@check("d4_hours_to_fly", with_(*O.FACT) + f"select quote_id,{R('total_fare/150.0::double', 4)} hours_to_fly,total_fare/150>40 is_strained from facts")
def d4(spark, sf):
    return analytics.hours_to_fly(tables.facts(spark, sf)).select("quote_id", "hours_to_fly", "is_strained")


_CONSENSUS = """c1 as (select *,sector||'|'||advance_days item from facts),cm as (select item,quantile_cont(total_fare,0.5) md from c1 group by 1),cn as (select c1.*,md,abs(total_fare-md)<md*0.2::double near from c1 join cm using (item))"""


def consensus_rows(spark: SparkSession, sf: str) -> DataFrame:
    return tables.facts(spark, sf).select("source", F.concat_ws("|", "sector", "advance_days").alias("item"), F.col("total_fare").alias("fare"))


@check("d5_consensus_fare", with_(*O.FACT, _CONSENSUS) + f"select item,count(*) agreeing_quotes,{R('quantile_cont(total_fare,0.5)', 4)} consensus_fare from cn where near group by 1")
def d5(spark, sf):
    return screening.consensus_fares(consensus_rows(spark, sf), ["item"]).withColumn("consensus_fare", to_places("consensus_fare", 4))


@check("d5_source_reliability", with_(*O.FACT, _CONSENSUS) + f"select source,count(*) quotes,{R('avg(cast(near as int)::double)', 6)} reliability from cn group by 1")
def d5_reliability(spark, sf):
    return screening.source_reliability(consensus_rows(spark, sf), ["item"]).withColumn("reliability", to_places("reliability", 6))


@check("d6_volatility", with_(*O.FACT) + f"select sector,{R('stddev_pop(total_fare)', 4)} std,{R('stddev_pop(total_fare)/avg(total_fare)', 6)} cv,count(*) quotes from facts group by 1")
def d6(spark, sf):
    return analytics.volatility(tables.facts(spark, sf)).withColumns({"std": to_places("std", 4), "cv": to_places("cv", 6)})


_FUEL = "fp as (select cast(o_orderdate as date) d,avg(o_totalprice) p from orders group by 1)"


def fuel_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The mean price of each day on which orders came in."""
    orders = tables.table(spark, sf, "orders")
    return orders.groupBy(F.to_date("o_orderdate").alias("price_date")).agg(F.avg("o_totalprice").alias("price"))


def fuelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.facts(spark, sf).select("quote_id", "sector", F.to_date("scrape_timestamp").alias("scrape_date"), "total_fare")
    return analytics.asof_fuel(rows, fuel_prices(spark, sf))


_ASOF = "af as (select f.*,(fp.p) fuel from facts f asof left join fp on fp.d<=cast(f.scrape_timestamp as date))"


@check("d8_asof_fuel", with_(*O.FACT, _FUEL, _ASOF) + f"select quote_id,{R('fuel', 4)} fuel_price from af")
def d8(spark, sf):
    return fuelled(spark, sf).select("quote_id", to_places("fuel_price", 4).alias("fuel_price"))


@check("d7_fuel_correlation", with_(*O.FACT, _FUEL, _ASOF) + f"select sector,{R('corr(total_fare,fuel)', 6)} correlation,count(*) points from af group by 1")
def d7(spark, sf):
    return analytics.fuel_correlation(fuelled(spark, sf), ["sector"], fare="total_fare").withColumn("correlation", to_places("correlation", 6))


@check("d9_three_sigma", with_(*O.FACT) + "select quote_id,abs(total_fare-avg(total_fare) over s)>3*stddev_pop(total_fare) over s outside_3_sigma from facts window s as (partition by sector)")
def d9(spark, sf):
    return screening.three_sigma(tables.facts(spark, sf)).select("quote_id", "outside_3_sigma")


@check("d10_income_ratio", with_(*O.FACT) + f"select origin_iata,destination_iata,{R('avg(total_fare)/any_value(' + O.case('origin_iata', C.INCOMES, '250000.0::double') + ')*100', 4)} fare_to_income_pct from facts group by 1,2")
def d10(spark, sf):
    means = tables.facts(spark, sf).groupBy("origin_iata", "destination_iata").agg(F.avg("total_fare").alias("average_fare"))
    return analytics.income_ratio(means).drop("average_fare")


# --- streaming: the stream is run over all that is there, into the shared folder, and read back ----

@check("r1_stream_quotes", with_(*O.BASE, f"so as (select * exclude (raw_total_fare),case when seats_available=0 and raw_total_fare<=0 then {C.SOLD_OUT_FARE}::double else raw_total_fare end raw_total_fare from valid)", O.parts("so")) + f"select quote_id,{','.join(PART_COLUMNS)} from pt")
def r1(spark, sf):
    raw = tables.raw_quotes_of(flows.table_stream(spark, sf, "lineitem"))
    return flows.run_available(flows.stream_quotes(raw).select("quote_id", *PART_COLUMNS), *flows.scratch_pair(spark, "r1"))


@check("r2_stream_dedup", with_(*O.FACT) + "select distinct concat_ws('-',l_orderkey,l_linenumber) id from facts")
def r2(spark, sf):
    facts = tables.facts_of(flows.table_stream(spark, sf, "lineitem")).select(
        F.substring_index("quote_id", "-", 2).alias("id"))
    return flows.run_first_sights(flows.stream_dedup(facts, "id"), *flows.scratch_pair(spark, "r2"), key="id").select("id")


@check("r3_trunk_volatility", with_(*O.FACT) + f"select cast(date_trunc('hour',scrape_timestamp) as varchar) \"hour\",sector,advance_days,count(*) quotes,{R('avg(total_fare)', 4)} mean_fare,{R('stddev_pop(total_fare)', 4)} std_fare from facts where sector in ({O.quoted(C.TRUNK_SECTORS)}) and advance_days in (1,7) group by 1,2,3")
def r3(spark, sf):
    facts = tables.facts_of(flows.table_stream(spark, sf, "lineitem")).select("sector", "advance_days", "scrape_timestamp", "total_fare")
    found = flows.run_trunk_volatility(facts, *flows.scratch_pair(spark, "r3"))
    return found.select(F.col("window.start").cast("string").alias("hour"), "sector", "advance_days", "quotes",
                        to_places("mean_fare", 4).alias("mean_fare"), to_places("std_fare", 4).alias("std_fare"))


@check("r4_stream_upsert", with_(*O.CLEAN) + "select quote_id,sector,total_fare,is_outlier,data_quality_score,is_quarantined from clean")
def r4(spark, sf):
    store, checkpoint = flows.scratch_pair(spark, "r4")
    flows.run_batches(tables.raw_quotes_of(flows.table_stream(spark, sf, "lineitem")), flows.upsert_batches(store), checkpoint)
    return quotes.read_store(spark, store).select("quote_id", "sector", "total_fare", "is_outlier", "data_quality_score", "is_quarantined")


@check("r5_published_series", "with recursive " + ",\n".join((*O.USE, _MONTHS, _ARRAYS, _fold_sql("mean"))) + "\n" + "select f.series_id,cast(lv.m as varchar) \"month\",f.pub[lv.idx+1] published_index from fold_mean f join lv on lv.series_id=f.series_id where f.t=len(f.arr)")
def r5(spark, sf):
    arrivals, (path, checkpoint) = flows.scratch_path(spark, "r5-levels"), flows.scratch_pair(spark, "r5")
    levels = carrier_months(spark, sf).select("series_id", day("month", "period"), "level")
    levels.write.parquet(arrivals)
    stream = spark.readStream.schema(levels.schema).parquet(arrivals)
    found = flows.latest_published(flows.run_published_series(stream, path, checkpoint))
    return found.select("series_id", F.col("period").alias("month"), "published_index")


# --- whole paths and further forms ------------------------------------------------------------

CLEANED = (*O.CLEAN, f"usable as (select * replace (upper(trim(flight_number)) as flight_number) from clean where data_quality_score>=80 and not is_outlier and not is_quarantined and sector in ({O.quoted(C.SECTOR_CODES)}))")


def cleaned_store(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P2, W2, A14 and P20 on raw quotes, stored (S10) and read back through P9."""
    store = flows.scratch_path(spark, "e2e")
    clean = quality.clean_quotes_batch(tables.valid_quotes(spark, sf))
    quotes.write_store(quotes.stored_form(weights.attach_dims(clean)), store)
    return quality.clean_quotes(quotes.read_store(spark, store)).filter(F.col("sector").isin(C.SECTOR_CODES))


def _e2e_sql(fare: str) -> str:
    usable = f"usable_y as (select * replace ({fare} as total_fare),year(travel_date) yr from usable)"
    return with_(*CLEANED, usable, *O.elementary("usable_y", "yr", "b.period=1995"), O.routes(), O.OMEGA, O.NATIONAL) + \
        "select period yr,composite_index,missing_cells_count from nat"


def _e2e(spark: SparkSession, sf: str, fare: str) -> DataFrame:
    usable = cleaned_store(spark, sf).withColumn("yr", F.year("travel_date"))
    cells = route.route_indices(elementary.elementary_indices(usable, "yr", 1995, fare), ["yr"], details=False)
    return national.national_laspeyres(cells, national.default_omega(spark), ["yr"]).select("yr", "composite_index", "missing_cells_count")


@check("e2e_year_index", _e2e_sql("total_fare"))
def e2e_year(spark, sf):
    return _e2e(spark, sf, "total_fare")


@check("f5_base_fare_index", _e2e_sql("base_fare"))
def f5(spark, sf):
    return _e2e(spark, sf, "base_fare")


LATER_SHARES = {"6E": 0.5, "AI": 0.3, "SG": 0.2}


@check("f6_two_share_tables", with_(*O.YEARLY[:-3]) + f"select period yr,sector,advance_days,{R('exp(0.5::double*(sum(w0*ln(index_value))/sum(w0)+sum(wt*ln(index_value))/sum(wt)))', 6)} index_value from (select *,{O.case('carrier_code', C.CARRIER_SHARES, str(C.UNKNOWN_CARRIER_SHARE))} w0,{O.case('carrier_code', LATER_SHARES, str(C.UNKNOWN_CARRIER_SHARE))} wt from elem) group by 1,2,3")
def f6(spark, sf):
    return route.route_indices(yearly_elementary(spark, sf), ["yr"], None, LATER_SHARES, details=False).drop("carriers")


@check("a9_without_imputation", with_(*O.YEARLY) + f"select period yr,{R('s', 4)} composite_index from nat0")
def a9_plain(spark, sf):
    return national.national_laspeyres(yearly_routes(spark, sf), national.default_omega(spark), ["yr"], impute=False).select("yr", "composite_index")


@check("a9_with_fallback", with_(*O.YEARLY) + f"select period yr,{R('s+((select sum(omega) from omega)-w)*100', 4)} composite_index from nat0")
def a9_fallback(spark, sf):
    return national.national_laspeyres(yearly_routes(spark, sf), national.default_omega(spark), ["yr"], False, 1.0).select("yr", "composite_index")


@check("w12_from_pairs", ORACLES["w6_w12_rygeks_mean"])
def w12_pairs(spark, sf):
    levels = carrier_months(spark, sf)
    pairs = multilateral.bilateral_pairs(levels, 14, period="month").select("series_id", "p_from", "p_to", "rel")
    found = multilateral.rygeks_series(pairwise=pairs, periods=levels.select("series_id", "month"), period="month")
    return found.select("series_id", day("month"), "published_index", F.lit("mean").alias("method"), "window_length", "is_expanding_window")


def quote_files(spark: SparkSession, sf: str, multi_line: bool) -> DataFrame:
    path = flows.scratch_path(spark, "quote-files")
    quotes.write_quotes(tables.raw_quotes(spark, sf), path)
    return quotes.read_quotes(spark, path, multi_line).select(
        "quote_id", "origin_iata", "carrier_code", day("travel_date"), F.col("raw_total_fare").cast("double"), "advance_days")


@check("s1_s2_file_round_trip", ORACLES["s1_read_quotes"])
def s1_files(spark, sf):
    return quote_files(spark, sf, multi_line=False)


@check("s1_split_objects", ORACLES["s1_read_quotes"])
def s1_objects(spark, sf):
    """The same files cut at the bounds of their objects instead of at line ends."""
    return quote_files(spark, sf, multi_line=True)


@check("a32_s17_report", with_(*O.USE, _SERIES) + f"select year(d) \"year\",cast(d as varchar) date,{R('predicted', 2)} predicted_fare,{R('actual', 2)} actual_fare from al")
def s17(spark, sf):
    """The nested report, written, read back and unnested."""
    path = flows.scratch_path(spark, "report")
    quotes.write_report(validation.backtest_report(aligned(spark, sf), ["year"]), path)
    entry = "struct<date:string,predicted_fare:double,actual_fare:double>"
    report = spark.read.schema(f"year int, time_series_comparison array<{entry}>").json(path)
    return report.select("year", F.inline("time_series_comparison"))


@check("s11_append_cpi", with_(O.CPI) + f"select code,count(*) n,{R('sum(index_value)', 2)} total from cpi group by 1")
def s11(spark, sf):
    path = flows.scratch_path(spark, "cpi")
    records = cpi_records(spark, sf)
    for load in (0, 1):
        cpi.append_cpi(records.filter(F.col("record_id") % 2 == load), path, load)
    return spark.read.parquet(path).groupBy("code").agg(F.count(F.lit(1)).alias("n"), to_places(F.sum("index_value"), 2).alias("total"))


HIGHER_FEES = {source: 2 * fee for source, fee in C.SOURCE_FEES.items()}
_TARIFF_SQL = O.parts("valid").replace(O.case("source", C.SOURCE_FEES), O.case("source", HIGHER_FEES)).replace("180", "200") \
    .replace("/1.05::double", "/1.12::double").replace("tx*0.05::double", "tx*0.12::double")


@check("f2_tariffs", with_(*O.BASE, _TARIFF_SQL) + f"select quote_id,{','.join(PART_COLUMNS)} from pt")
def f2(spark, sf):
    """A service-fee table, a convenience-fee table and a tax rate of the caller's own."""
    valid = tables.valid_quotes(spark, sf)
    psf = valid.select(F.col("origin_iata").alias("origin")).distinct().withColumn("psf", F.lit(200.0))
    fees = spark.createDataFrame(list(HIGHER_FEES.items()), "source string, fee double")
    return decompose.decompose_fare(valid, gst_rate=0.12, exact=False, psf_rates=psf, fees=fees).select("quote_id", *PART_COLUMNS)
