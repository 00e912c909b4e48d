"""Quotes from crawled pages.

Input is a table of pages already fetched: source, origin_iata, destination_iata,
travel_date, advance_days, the page text, and for airline pages the carrier's own code.
Everything is a column expression. A page yields all its flights; ``position`` numbers them,
so a caller who wants the first few (T4) filters on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.text import clock_time, row_key
from fareloom.operators.normalize import split_total_70_30
from fareloom.session import computed_once
from fareloom.sources.schemas import MONEY, RAW_QUOTE

# fixed values: where a payload keeps its flight list, in order of preference
LIST_KEYS = {
    "airline": ["trips", "flights", "journeys", "data", "itineraries", "results", "outboundFlights"],
    "agency": ["flights", "trips", "itineraries", "journeys", "results", "data"],
}
SUB_KEYS = ["journeys", "flights", "fares"]
FLIGHT_FIELDS = [
    "flightNumber", "flightNo", "flight_number", "departureTime", "depTime", "arrivalTime", "arrTime",
    "totalFare", "fare", "price", "amount", "carrierCode", "carrier", "airlineCode",
]
# fixed values: marks of a flight card, in order of preference
CARD_MARKS = {
    "airline": [
        ("class", "flight-card"), ("class", "flight-item"), ("class", "itinerary-card"), ("class", "flt-opt"),
        ("testid", "flight"), ("div id", "divFlight"), ("div class", "fli-list"), ("class", "flight-details-card"),
        ("class", "c-flight-listing-split-row"), ("class", "fare-row"), ("div class part", "FlightCard"),
        ("div class part", "flight-row"), ("div class", "flt-row"),
    ],
    "agency": [
        ("class", "listingCard"), ("class", "fli-list"), ("class", "flight-card"), ("class", "itinerary-card"),
        ("class", "flight-item"), ("class", "flt-opt"), ("div id", "divFlight"), ("class", "flt-row"),
        ("class", "c-flight-listing-split-row"), ("div component", "flightCard"), ("div class part", "FlightCard"),
        ("div class part", "flight-row"),
    ],
}
FLIGHT = r"(?i)\b(6E|AI|IX|QP|SG)[ -]?([0-9]{3,4})\b"
RUPEES = r"(?i)(?:₹|Rs\.?|INR)\s*([0-9,]{4,7})"
BARE_AMOUNT = r"\b([0-9,]{4,6})\b"
CLOCK = r"\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9]\b"
TAG = r"^<([a-zA-Z][a-zA-Z0-9]*)"
MAIN_END = r"(?is)<(?:footer|/main|/body)\b.*$"
DEFAULT_DEPARTS, DEFAULT_ARRIVES = "08:00", "10:15"
PAGE_COLUMNS = ["source", "origin_iata", "destination_iata", "travel_date", "advance_days"]


def _filled(value: Column) -> Column:
    """Null for what counts as empty: nothing, blank text, zero, false."""
    return F.when(value.isNotNull() & ~value.isin("", "0", "0.0", "false", "null"), value)


def _first_filled(row: Column, names: list[str]) -> Column:
    return F.coalesce(*[_filled(row[n]) for n in names])


def _fields(text: Column, names: list[str]) -> Column:
    """The named members of a JSON object as JSON text, in one parse."""
    return F.from_json(text, "struct<" + ",".join(f"{n}:string" for n in names) + ">")


def flight_list(payload: Column, kind: str) -> Column:
    """The JSON text of the first flight list in a payload.

    The payload is parsed once into its candidate members; a member is parsed again only
    if it is an object that may hold the list one level down.
    """
    members = F.transform(F.array(_fields(payload, LIST_KEYS[kind])), lambda m: F.array(*[m[k] for k in LIST_KEYS[kind]]))

    def listed(member: Column) -> Column:
        inside = F.transform(F.array(_fields(member, SUB_KEYS)), lambda s: F.coalesce(
            *[F.when(s[k].startswith("[") & (s[k] != "[]"), s[k]) for k in SUB_KEYS]))
        return F.when(member.startswith("["), member).when(member.startswith("{"), F.get(inside, F.lit(0)))

    found = F.filter(F.transform(F.get(members, F.lit(0)), listed), lambda text: text.isNotNull())
    return F.get(found, F.lit(0))


def _raw_quotes(rows: DataFrame, kind: str, fee: Column | None) -> DataFrame:
    """Common end of S12 and S14: fare limits, then P8 to a raw quote."""
    fare = F.translate(F.trim("fare_text"), ",", "").try_cast(MONEY.simpleString())
    rows = computed_once(rows, raw_total_fare=fare).filter(F.col("raw_total_fare").between(C.FARE_FLOOR, C.EXTRACT_FARE_MAX))
    own = F.lit(0.0) if kind == "airline" else F.lit(0.0) if fee is None else fee
    rows = split_total_70_30(rows.withColumn("raw_convenience_fee", own))
    have = {
        "quote_id": row_key(*PAGE_COLUMNS, "carrier_code", "flight_number", "departure_time", "raw_total_fare", "position"),
        "source_type": F.lit("airline" if kind == "airline" else "ota"), "stops": F.lit(0),
        "fare_class": F.lit("economy"), "currency": F.lit("INR"), "seats_available": F.lit(9),
        "is_sold_out": F.lit(False),
    }
    if "scrape_timestamp" not in rows.columns:
        have["scrape_timestamp"] = F.date_sub("travel_date", F.col("advance_days"))
    rows = rows.withColumns(have)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_QUOTE.fields], "position",
                       *[c for c in ("page_id",) if c in rows.columns])


def _fee(rows: DataFrame) -> Column | None:
    return F.col("platform_fee").cast("double") if "platform_fee" in rows.columns else None


def quotes_from_json(df: DataFrame, payload: str = "payload", kind: str = "airline") -> DataFrame:
    """Flight list -> items -> quotes. Airline pages need ``own_carrier``;
    agency pages may carry ``platform_fee``."""
    # one value per page, so that the list is found once and not once for each use; items
    # are parsed one by one, so an item that is no object spoils only itself
    lists = F.transform(F.array(F.col(payload)), lambda p: F.from_json(flight_list(p, kind), "array<string>"))
    rows = computed_once(df, **{payload: F.col(payload)}).select(*df.columns, F.posexplode(F.get(lists, F.lit(0))).alias("position", "item"))
    # out of a generator, so that an item is parsed once and not once for each use of a member
    rows = rows.select(*df.columns, "position", F.explode(F.array(_fields(F.col("item"), FLIGHT_FIELDS))).alias("fl"))
    fl = F.col("fl")
    number = _first_filled(fl, ["flightNumber", "flightNo", "flight_number"])
    made_up = (F.col("position") + 1000).cast("string")
    if kind == "airline":
        carrier = F.col("own_carrier")
        number = F.coalesce(number, F.concat_ws("-", carrier, made_up))
        full = F.when(number.startswith(carrier), number).otherwise(F.concat_ws("-", carrier, number))
    else:
        stated = F.upper(_first_filled(fl, ["carrierCode", "carrier", "airlineCode"]))
        digits = F.regexp_extract(number, FLIGHT, 2)
        parsed = F.when(digits != "", F.upper(F.regexp_extract(number, FLIGHT, 1)))
        carrier = F.coalesce(stated, parsed, F.lit("6E"))
        text = F.coalesce(number, F.lit(""))
        full = (F.when(stated.isNotNull(), F.when(text.startswith(stated), text).otherwise(F.concat_ws("-", stated, text)))
                .when(parsed.isNotNull(), F.concat_ws("-", parsed, digits)).otherwise(F.concat_ws("-", F.lit("6E"), made_up)))
    price = _first_filled(fl, ["totalFare", "fare", "price", "amount"])
    # each member is looked up once, and only where the price is an object
    members = F.transform(F.array(*[F.get_json_object("price", f"$.{k}") for k in ("total", "amount", "value")]), _filled)
    nested = F.get(F.filter(members, lambda value: value.isNotNull()), F.lit(0))
    rows, price = computed_once(rows, price=price), F.col("price")
    rows = rows.withColumns({
        "carrier_code": carrier, "flight_number": full,
        "departure_time": clock_time(F.coalesce(_first_filled(fl, ["departureTime", "depTime"]), F.lit(DEFAULT_DEPARTS))),
        "arrival_time": clock_time(F.coalesce(_first_filled(fl, ["arrivalTime", "arrTime"]), F.lit(DEFAULT_ARRIVES))),
        "fare_text": F.when(price.startswith("{"), nested).otherwise(price),
    })
    return _raw_quotes(rows, kind, _fee(df))


def embedded_state(html: Column) -> Column:
    """The JSON a page carries in a data script, else in a window assignment."""
    script = F.regexp_extract(html, r"(?is)<script[^>]*\bid=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    props = F.get_json_object(script, "$.props.pageProps")
    state = F.regexp_extract(html, r"(?s)window\.(?:__INITIAL_STATE__|flightSearchData)\s*=\s*(\{.*?\});", 1)
    return F.coalesce(props, F.when(state != "", state))


def quotes_from_embedded_state(df: DataFrame, html: str = "html", kind: str = "airline") -> DataFrame:
    """S13."""
    return quotes_from_json(computed_once(df, **{html: F.col(html)}).withColumn("payload", embedded_state(F.col(html))), "payload", kind)


def _mark_pattern(form: str, word: str) -> str:
    tag = "div" if form.startswith("div") else "[a-zA-Z][a-zA-Z0-9]*"
    part = {
        "class": rf"class=[\"'](?:[^\"']*\s)?{word}(?:\s[^\"']*)?[\"']",
        "div class": rf"class=[\"'](?:[^\"']*\s)?{word}(?:\s[^\"']*)?[\"']",
        "div class part": rf"class=[\"'][^\"']*{word}[^\"']*[\"']",
        "testid": rf"data-testid=[\"'][^\"']*{word}[^\"']*[\"']",
        "div id": rf"id=[\"']{word}[^\"']*[\"']",
        "div component": rf"data-component=[\"']{word}[\"']",
    }[form]
    return rf"<{tag}\s(?:[^>]*\s)?{part}[^>]*>"


def _closed(rest: Column, name: Column) -> Column:
    """What stands before the tag that closes a card, whose opening tag has this name; null if none does.

    Only tags of the card's own name are looked at, so other tags need not be closed.
    """
    pattern = F.concat(F.lit("(?i)</?"), name, F.lit(r"\b[^>]*>"))

    def step(seen: Column, tag: Column) -> Column:  # seen: depth below the card's own tag, tags passed
        change = F.when(tag.startswith("</"), -1).when(tag.endswith("/>"), 0).otherwise(1)
        return F.when(seen["depth"] == 0, seen).otherwise(F.struct((seen["depth"] + change).alias("depth"), (seen["n"] + 1).alias("n")))

    opened = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    ends = F.aggregate(F.regexp_extract_all(rest, pattern, F.lit(0)), opened, step, lambda seen: F.when(seen["depth"] == 0, seen["n"]))
    return F.get(F.transform(F.array(ends), lambda n: F.when(n.isNotNull(), F.array_join(F.slice(F.split(rest, pattern, n + 1), F.lit(1), n), " "))), F.lit(0))


def quotes_from_cards(df: DataFrame, html: str = "html", kind: str = "airline") -> DataFrame:
    """The page's flight cards, and the text of each.

    A card ends at its own closing tag, by the depth of the tags of its name: cards inside a
    card are cards too, and part of its text. One that is never closed ends where the next
    card starts, or the page's main part. Airline pages need ``own_carrier``: bare
    digits then count as its flight number, and cards of other carriers are left out.
    """
    page = F.col(html)
    patterns = [_mark_pattern(*mark) for mark in CARD_MARKS[kind]]
    mark = F.coalesce(*[F.when(page.rlike(p), F.lit(p)) for p in patterns])
    marked = df.withColumn("mark", mark).filter(F.col("mark").isNotNull())
    names = F.transform(F.regexp_extract_all(page, F.col("mark"), F.lit(0)), lambda t: F.regexp_extract(t, TAG, 1))
    marked = marked.select(*df.columns, F.explode(F.array(F.struct(F.split(page, F.col("mark")).alias("pieces"), names.alias("names")))).alias("cut"))
    marked = marked.select(*df.columns, "cut.pieces", "cut.names")
    rows = marked.select(*df.columns, "pieces", F.posexplode("names").alias("position", "name"))
    own = F.get("pieces", F.col("position") + 1)
    # a card with others inside goes on beyond the next mark
    whole = F.call_function("array_join", F.slice("pieces", F.col("position") + 2, F.size("pieces")), F.concat(F.lit("<"), F.col("name"), F.lit(">")))
    rows = rows.select(*df.columns, "position", F.coalesce(_closed(own, F.col("name")), _closed(whole, F.col("name")), own).alias("card"))
    inside = F.regexp_replace("card", MAIN_END, "")
    plain = F.regexp_replace(F.regexp_replace(inside, "(?s)<[^>]*(?:>|$)", " "), r"&#8377;|&#x20[bB]9;", "₹")
    rows = rows.withColumn("card", F.trim(F.regexp_replace(F.regexp_replace(plain, "&nbsp;|&#160;", " "), r"\s+", " ")))
    card = F.col("card")
    named = F.when(F.regexp_extract(card, FLIGHT, 1) != "", F.upper(F.regexp_extract(card, FLIGHT, 1)))
    digits = F.regexp_extract(card, FLIGHT, 2)
    if kind == "airline":
        bare = F.regexp_extract(card, r"\b([0-9]{3,4})\b", 1)
        carrier = F.coalesce(named, F.when(bare != "", F.col("own_carrier")))
        number = F.when(named.isNotNull(), digits).otherwise(bare)
        rows = rows.withColumns({"carrier_code": carrier, "flight_number": F.concat(carrier, F.lit("-"), number)})
        rows = rows.filter(F.col("carrier_code") == F.col("own_carrier"))
    else:
        rows = rows.withColumns({"carrier_code": named, "flight_number": F.concat(named, F.lit("-"), digits)})
        rows = rows.filter(F.col("carrier_code").isNotNull())
    times = F.regexp_extract_all(card, F.lit(CLOCK), F.lit(0))
    both = F.size(times) >= 2
    priced, bare_price = F.regexp_extract(card, RUPEES, 1), F.regexp_extract(card, BARE_AMOUNT, 1)
    rows = rows.withColumns({
        "departure_time": F.when(both, F.lpad(F.get(times, F.lit(0)), 5, "0")).otherwise(DEFAULT_DEPARTS),
        "arrival_time": F.when(both, F.lpad(F.get(times, F.lit(1)), 5, "0")).otherwise(DEFAULT_ARRIVES),
        "fare_text": F.when(priced != "", priced).otherwise(bare_price),
    })
    return _raw_quotes(rows, kind, _fee(df))
