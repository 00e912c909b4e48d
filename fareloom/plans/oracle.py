"""SQL building blocks for the checks: the table views and the index stages as CTEs."""

from __future__ import annotations

from collections.abc import Mapping

from fareloom import constants as C
from fareloom.sources.tables import FARE_STEPS, REGION_SHARES, SECTOR_RING


def R(expr: str, places: int) -> str:
    """The rounding rule of ``functions.numeric.to_places``."""
    scale = f"{float(10**places)}"
    return f"(floor(cast({expr} as double)*{scale}+0.5000001)/{scale})"


def items(values) -> str:
    return "[" + ",".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def case(key: str, table: Mapping, default: str = "null") -> str:
    whens = " ".join(f"when '{k}' then " + (f"'{v}'" if isinstance(v, str) else f"cast({v} as double)") for k, v in table.items())
    return f"(case {key} {whens} else {default} end)"


def quoted(values) -> str:
    return ",".join(f"'{v}'" for v in values)


def with_(*blocks: str) -> str:
    return "with " + ",\n".join(blocks) + "\n"


_USUAL = f"floor((floor(cents/16)+200000)*({items(FARE_STEPS)}[l_linenumber%5+1])/100)"
LINES = f"""lines as (select *, round(l_extendedprice*100) cents,
  {items(SECTOR_RING)}[(l_partkey*3+l_suppkey)%32+1] ring, {items(C.CARRIER_CODES)}[l_suppkey%5+1] carrier,
  {items([c[4] for c in C.CARRIERS])}[l_suppkey%5+1] direct, {items(C.WINDOWS)}[l_linenumber%5+1] lead_days,
  (l_partkey%40+8)*30 leaves, case when l_orderkey%97=0 then 0 else (l_partkey%7)*15+60 end lasts,
  cast(l_shipdate as date) travel from lineitem)"""


def _clock(m: str) -> str:
    return f"lpad(cast({m}//60 as varchar),2,'0')||':'||lpad(cast(({m})%60 as varchar),2,'0')"


NORM = f"""norm as (select concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey,cast(cents as bigint),cast(travel as varchar)) quote_id,
  case when l_partkey%9<5 then direct else {items(C.AGENCIES)}[l_partkey%9-4] end source,
  case when l_partkey%9<5 then 'airline' else 'ota' end source_type,
  cast(travel - cast(lead_days as int) as timestamp) + to_minutes(cast((l_orderkey%24)*60+l_partkey%60 as bigint)) scrape_timestamp,
  substr(ring,1,3) origin_iata, substr(ring,5,3) destination_iata, carrier carrier_code,
  case when l_orderkey%3=0 then lower(carrier)||' '||cast(l_partkey%40+100 as varchar) else carrier||'-'||cast(l_partkey%40+100 as varchar) end flight_number,
  {_clock('leaves')} departure_time, case when l_orderkey%89<>0 then {_clock('((leaves+lasts)%1440)')} end arrival_time,
  travel travel_date, lead_days advance_days, lasts duration_minutes, l_linenumber%2 stops,
  case when l_orderkey%50=0 then 99.0::double end raw_convenience_fee,
  case when l_orderkey%11=0 and cast(floor(l_quantity) as int)%10=0 then 0.0::double
       when l_orderkey%53=0 then floor(cents/4)/100 else {_USUAL}/100 end raw_total_fare,
  cast(floor(l_quantity) as int)%10 seats_available, false is_sold_out, l_orderkey, l_linenumber, l_returnflag from lines)"""
VALID = """valid as (select * from norm where origin_iata<>destination_iata and arrival_time is not null and duration_minutes>0)"""
FACTS = f"""f0 as (select quote_id, scrape_timestamp, origin_iata||'-'||destination_iata sector, origin_iata, destination_iata, carrier_code,
  source, source_type, travel_date, advance_days, upper(replace(flight_number,' ','-')) flight_number, departure_time, seats_available,
  seats_available=0 is_sold_out, l_orderkey, l_linenumber, l_returnflag,
  case when seats_available=0 and raw_total_fare<=0 then {C.SOLD_OUT_FARE}::double else raw_total_fare end total_fare from valid),
facts as (select *, (total_fare<999 or total_fare>25000) is_outlier, (total_fare<999 or total_fare>25000) is_quarantined,
  case when total_fare<999 then 'DOMAIN_FLOOR' when total_fare>25000 then 'DOMAIN_CEILING' end outlier_reason,
  case when total_fare<999 or total_fare>25000 then 60.0::double else 85.0::double end + case when source_type='airline' then 15 else 13 end data_quality_score from f0)"""
USABLE = f"usable as (select * from facts where data_quality_score>=80 and not is_outlier and not is_quarantined and sector in ({quoted(C.SECTOR_CODES)}))"
BASE = (LINES, NORM, VALID)
FACT = (*BASE, FACTS)
USE = (*FACT, USABLE)

OMEGA = "omega as (select * from (values " + ",".join(
    f"('{s}',{w},'{C.SECTOR_TIERS[s]}',cast({C.SECTOR_WEIGHTS[s] * C.WINDOW_WEIGHTS[w]!r} as double))"
    for s in sorted(C.SECTOR_CODES) for w in C.WINDOWS) + ") o(sector,advance_days,route_tier,omega))"


def elementary(source: str, period: str, base_of: str, day: str = "travel_date") -> tuple[str, ...]:
    """Stage 1 blocks; ``base_of`` is the condition that pairs base ``b`` with current ``c``."""
    keys = "sector,carrier_code,advance_days"
    on = " and ".join(f"b.{k}=c.{k}" for k in keys.split(","))
    return (
        f"num as (select {period} period,{keys},flight_number,departure_time,total_fare fare, row_number() over (partition by {period},{keys},flight_number,departure_time order by {day},quote_id) k from {source} where total_fare>0)",
        f"gm as (select {period} period,{keys},count(*) n, avg(case when total_fare>0 then ln(total_fare) end) lg from {source} group by all)",
        f"pr as (select c.period,c.sector,c.carrier_code,c.advance_days,count(*) m, avg(ln(c.fare)-ln(b.fare)) lm from num c join num b on {on} and b.flight_number=c.flight_number and b.departure_time=c.departure_time and b.k=c.k and {base_of} group by all)",
        f"elem as (select c.period,c.sector,c.carrier_code,c.advance_days,b.n base_quote_count,c.n current_quote_count,coalesce(p.m,0) matched_quote_count,{R('exp(b.lg)', 4)} base_geometric_mean,{R('exp(c.lg)', 4)} current_geometric_mean,"
        f"{R('coalesce(exp(p.lm),exp(c.lg-b.lg))', 6)} index_value from gm c join gm b on {on} and {base_of} left join pr p on p.period=c.period and p.sector=c.sector and p.carrier_code=c.carrier_code and p.advance_days=c.advance_days where b.lg is not null and c.lg is not null)",
    )


def routes(shares: Mapping = C.CARRIER_SHARES) -> str:
    w = case("carrier_code", shares, str(C.UNKNOWN_CARRIER_SHARE))
    return f"route as (select period,sector,advance_days,{R('exp(sum(w*ln(index_value))/sum(w))', 6)} index_value,count(*) carriers from (select *,{w} w from elem) group by all)"


NATIONAL = f"""obs as (select r.period,r.sector,r.advance_days,o.route_tier,o.omega,r.index_value from route r join omega o using (sector,advance_days)),
nat0 as (select period,sum(omega*index_value*100) s,sum(omega) w,count(*) n from obs group by 1),
nat as (select period,{R('case when n=(select count(*) from omega) then s else s/w end', 4)} composite_index,{R('case when n=(select count(*) from omega) then s/100 else s/w/100 end', 6)} composite_relative,
 {R('w', 7)} total_observed_weight,(n=(select count(*) from omega)) is_fully_observed,(select count(*) from omega)-n missing_cells_count,w,n from nat0)"""
LAGGED = "b.period=c.period-30"
DAILY = (*USE, *elementary("usable", "travel_date", LAGGED), routes(), OMEGA, NATIONAL,
         """cnt as (select travel_date period,count(*) total_quotes from usable group by 1),
daily as (select c.period,c.total_quotes,case when c.total_quotes>=10 and b.total_quotes>=10 then n.composite_index end composite_index,
 case when c.total_quotes>=10 and b.total_quotes>=10 then n.missing_cells_count end missing_cells_count
 from cnt c left join cnt b on b.period=c.period-30 left join nat n on n.period=c.period)""")
YEARLY = (*USE, "usable_y as (select *,year(travel_date) yr from usable)",
          *elementary("usable_y", "yr", "b.period=1995"), routes(), OMEGA, NATIONAL)

REGION = f"""region_quotes as (select concat_ws('-',l_orderkey,l_linenumber,l_partkey,l_suppkey,cast(floor(round(l_extendedprice*100)/4) as bigint),cast(cast(l_shipdate as date) as varchar)) quote_id,
 'R'||sn.n_regionkey||'-R'||cn.n_regionkey sector,'C'||l_suppkey%5 carrier_code,{items(C.WINDOWS)}[l_linenumber%5+1] advance_days,'C'||l_suppkey%5||'-'||l_partkey%40 flight_number,'' departure_time,
 cast(l_shipdate as date) travel_date,year(l_shipdate) yr,floor(round(l_extendedprice*100)/4)/100 total_fare
 from lineitem join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey join nation cn on cn.n_nationkey=c_nationkey
 join supplier on s_suppkey=l_suppkey join nation sn on sn.n_nationkey=s_nationkey where sn.n_regionkey<>cn.n_regionkey),
region_use as (select * from region_quotes where total_fare between 999 and 25000)"""
REGION_INDEX = (REGION, *elementary("region_use", "yr", "b.period=1995"), routes(REGION_SHARES))


def quartiles(source: str, keys: str, fare: str, name: str = "st") -> str:
    return f"{name} as (select {keys},count({fare}) n,quantile_cont({fare},0.25) q1,quantile_cont({fare},0.5) md,quantile_cont({fare},0.75) q3 from {source} group by all)"


BOUNDS = """greatest(999, case when q3-q1<1 then md*0.85 else q1-1.5*(q3-q1) end)""", """least(25000, case when q3-q1<1 then md*1.15 else q3+1.5*(q3-q1) end)"""
DEDUP = f"""dd as (select * from (select *, origin_iata||'-'||destination_iata sector, isodow(travel_date)-1 weekday, row_number() over (partition by origin_iata,destination_iata,carrier_code,regexp_replace(upper(flight_number),'[^A-Z0-9]','','g'),travel_date
 order by case when source in ({quoted(C.DIRECT_SOURCES)}) then 0 else 1 end,raw_total_fare,scrape_timestamp,quote_id) rn from valid) where rn=1)"""
COHORT = f"""{quartiles('dd', 'sector,advance_days,weekday', 'raw_total_fare')},
co as (select dd.*, n cohort_size, md cohort_median, case when q3-q1<1 then least({BOUNDS[0]},{BOUNDS[1]}) else {BOUNDS[0]} end lower_bound,
 case when q3-q1<1 then greatest({BOUNDS[0]},{BOUNDS[1]}) else {BOUNDS[1]} end upper_bound from dd join st using (sector,advance_days,weekday))"""


def parts(source: str, name: str = "pt", fee: str = "raw_convenience_fee") -> str:
    udf = f"coalesce({case('origin_iata', C.UDF_PRIMARY)},{C.UDF_DEFAULT}::double)"
    fees = f"coalesce({fee},{case('source', C.SOURCE_FEES)},0.0::double)"
    return f"""{name}0 as (select *, {udf} u, {fees} fe from {source}),
{name}1 as (select *, greatest(0.0::double,(gross-u-180.0::double-fe)/1.05::double) tx from (select *, raw_total_fare gross from {name}0)),
{name}2 as (select *, {R('tx*0.05::double', 2)} gst, {R('case when tx<=0 then 0.0::double when tx<400 then tx else least(1200.0::double,greatest(400.0::double,tx*0.25::double)) end', 2)} fu0 from {name}1),
{name}3 as (select *, case when {R('gross-fu0-gst-u-180-fe', 2)}<0 and gross>=999 then greatest(0.0::double,{R('fu0+(gross-fu0-gst-u-180-fe)', 2)}) else fu0 end fuel_surcharge from {name}2),
{name} as (select *, {R('gross-fuel_surcharge-gst-u-180-fe', 2)} base_fare, gst airport_taxes_gst, u user_dev_fee, 180.0::double passenger_service_fee, fe convenience_fee, gross total_fare from {name}3)"""


SOLD = f"""so as (select * exclude (raw_total_fare,is_sold_out), case when seats_available=0 and raw_total_fare<=0 then {C.SOLD_OUT_FARE}::double else raw_total_fare end raw_total_fare, seats_available=0 is_sold_out from co)"""
SCORE = f"""fl as (select *, list_filter([case when gross<999 then 'DOMAIN_FLOOR' end,case when gross>25000 then 'DOMAIN_CEILING' end,
 case when cohort_size>=5 and (gross<lower_bound or gross>upper_bound) then 'STATISTICAL_IQR' end,
 case when cohort_median>0 and abs(gross-cohort_median)/cohort_median*100>50 then 'CROSS_SOURCE_VARIANCE' end], lambda x: x is not null) flags from pt),
cl as (select *, len(flags)>0 is_outlier, flags[1] outlier_reason, 25.0::double s1, 20.0::double s2,
 case when gross<999 or gross>25000 then 0.0::double when len(flags)=0 then 25.0::double else 10.0::double end s3,
 case when cohort_median is null or cohort_median<=0 then 15.0::double when abs(gross-cohort_median)/cohort_median<=0.05 then 15.0::double when abs(gross-cohort_median)/cohort_median<=0.2 then 10.0::double when abs(gross-cohort_median)/cohort_median<=0.5 then 5.0::double else 0.0::double end s4,
 case when source in ({quoted(C.DIRECT_SOURCES)}) then 15.0::double when source in ({quoted(C.AGENCY_SOURCES)}) then 13.0::double else 8.0::double end s5 from fl),
clean as (select *, s1+s2+s3+s4+s5 data_quality_score, (s1+s2+s3+s4+s5<60) or list_contains(flags,'DOMAIN_FLOOR') or list_contains(flags,'DOMAIN_CEILING') is_quarantined from cl)"""
CLEAN = (*BASE, DEDUP, COHORT, SOLD, parts("so"), SCORE)

CPI = f"""cpi as (select o_orderkey record_id,'2024' base_year,strftime(o_orderdate,'%Y') "year",strftime(o_orderdate,'%B') "month",
 case when o_custkey%3=0 then 'All India' else 'Delhi' end state, coalesce(case when o_custkey%2=0 then 'Combined' when o_custkey%5<>0 then 'Urban' end,'Combined') sector,
 ['Transport','Transport','CPI (General)','Food'][o_orderkey%4+1] division,['{C.CPI_AIRFARE_CODE}','07','00','01'][o_orderkey%4+1] code,o_orderpriority item_class,
 case when o_orderkey%13=0 then 100.0::double else floor(round(o_totalprice*100)/1000)/100 end index_value, case when o_orderkey%7=0 then null else cast(o_orderkey%50 as double) end inflation_pct from orders)"""
