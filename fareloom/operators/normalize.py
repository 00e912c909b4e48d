"""From whatever a source sends to a valid raw quote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareloom import constants as C
from fareloom.functions import text
from fareloom.functions.numeric import lookup
from fareloom.sources.schemas import FARE_PARTS, MONEY, RAW_ALIASES, RAW_QUOTE

DEFAULTS = {
    "source_type": "airline", "stops": 0, "fare_class": "economy",
    "currency": "INR", "is_sold_out": False,
}


def _first_present(df: DataFrame, names: list[str], kind: str) -> Column:
    types = dict(df.dtypes)
    present = [F.col(n) if types[n] == kind else F.col(n).cast("string").try_cast(kind) for n in names if n in types]
    return F.coalesce(*present) if present else F.lit(None).cast(kind)


def normalize_quotes(df: DataFrame) -> DataFrame:
    """Fill canonical columns from their aliases and tidy codes; other columns go.

    A canonical column wins over its alias. ``departure_datetime`` supplies the travel
    date and the departure time where those are missing.
    """
    aliases: dict[str, list[str]] = {}
    for alias, name in RAW_ALIASES.items():
        aliases.setdefault(name, []).append(alias)
    departs = _first_present(df, ["departure_datetime"], "timestamp")
    out = []
    for field in RAW_QUOTE.fields:
        name, kind = field.name, field.dataType.simpleString()
        if name == "scrape_timestamp":
            value = _first_present(df, [name, "scrape_date", "search_datetime"], kind)
        elif name == "travel_date":
            value = F.coalesce(_first_present(df, [name], "date"), F.to_date(departs))
        elif name == "departure_time":
            value = F.coalesce(_first_present(df, [name], "string"), F.date_format(departs, "HH:mm"))
        else:
            value = _first_present(df, [name, *aliases.get(name, [])], kind)
        if name in ("origin_iata", "destination_iata", "carrier_code"):
            value = text.code(value)
        if name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[name]))
        out.append(value.alias(name))
    return df.select(*out)


def _rules() -> dict[str, Column]:
    """Whether a raw quote breaks a rule, by the rule's name and in rule order; never null."""
    required = ["source", "flight_number", "departure_time", "arrival_time", "travel_date", "raw_total_fare"]
    broken = {f"missing_{name}": F.col(name).isNull() for name in required}
    known = {
        "bad_origin": ~F.col("origin_iata").rlike(text.IATA_PATTERN),
        "bad_destination": ~F.col("destination_iata").rlike(text.IATA_PATTERN),
        "same_airport": F.col("origin_iata") == F.col("destination_iata"),
        "bad_carrier": ~F.length("carrier_code").between(2, 3),
        "negative_lead_time": F.col("advance_days") < 0,
        "bad_duration": F.col("duration_minutes") <= 0,
        "negative_stops": F.col("stops") < 0,
    }
    broken |= {name: F.coalesce(rule, F.lit(True)) for name, rule in known.items()}
    return broken | {"negative_seats": F.coalesce(F.col("seats_available") < 0, F.lit(False))}


def violations() -> Column:
    """Names of the rules a raw quote breaks, in rule order; codes as P1 leaves them."""
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in _rules().items()]), lambda name: name.isNotNull())


def validate_quotes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``violations``).

    Valid rows are told by the rules alone; their names are put together for rejected rows only.
    """
    broken = reduce(lambda a, b: a | b, _rules().values())
    return df.filter(~broken), df.filter(broken).withColumn("violations", violations())


def reconcile_clean(df: DataFrame) -> DataFrame:
    """Canonical names for clean rows that arrive under older ones."""
    columns = set(df.columns)

    def pick(name: str, *others: Column) -> Column:
        own = [F.col(name)] if name in columns else []
        options = own + list(others)
        return F.coalesce(*options) if options else F.lit(None)

    nested: dict[str, Column] = {}
    if "decomposed_fare" in columns:
        inner = df.schema["decomposed_fare"].dataType
        names = inner.fieldNames() if isinstance(inner, T.StructType) else []
        nested = {n: F.col(f"decomposed_fare.{n}") for n in names}
    split = F.split(F.col("sector"), "-") if "sector" in columns else None
    parts = [F.when(F.size(split) == 2, split[i]) for i in (0, 1)] if split is not None else [None, None]

    def given(*names: str) -> list[Column]:
        return [F.col(n) for n in names if n in columns] + [nested[n] for n in names if n in nested]

    changes = {
        "data_quality_score": pick("data_quality_score", *given("quality_score")),
        "advance_days": pick("advance_days", *given("advance_window")),
        "carrier_code": pick("carrier_code", *given("carrier")),
        "origin_iata": pick("origin_iata", *([parts[0]] if parts[0] is not None else [])),
        "destination_iata": pick("destination_iata", *([parts[1]] if parts[1] is not None else [])),
    }
    pair = [F.col(c) for c in ("origin_iata", "destination_iata") if c in columns]
    if len(pair) == 2:
        joined = F.when(pair[0].isNotNull() & pair[1].isNotNull(), F.concat_ws("-", *pair))
        changes["sector"] = pick("sector", joined)
    for part in [*FARE_PARTS, "total_fare"]:
        others = given("user_development_fee") if part == "user_dev_fee" else []
        inside = [nested[part]] if part in nested else []
        if part in columns or others or inside:
            changes[part] = pick(part, *others, *inside)
    return df.withColumns(changes)


def handle_sold_out(df: DataFrame, ceiling: float = C.SOLD_OUT_FARE) -> DataFrame:
    """No seats means sold out; a fare of nothing becomes the reservation ceiling."""
    gone = F.coalesce(F.col("is_sold_out"), F.lit(False)) | F.coalesce(F.col("seats_available") == 0, F.lit(False))
    fare = F.col("raw_total_fare")
    kind = df.schema["raw_total_fare"].dataType
    return df.withColumns({
        "raw_total_fare": F.when(gone & (F.coalesce(fare, F.lit(0)) <= 0), F.lit(ceiling).cast(kind)).otherwise(fare),
        "seats_available": F.when(gone, 0).otherwise(F.col("seats_available")),
        "is_sold_out": gone,
    })


def split_total_70_30(
    df: DataFrame, udf: dict[str, float] | None = None, udf_default: float = C.UDF_EXTRACTION_DEFAULT,
) -> DataFrame:
    """The coarser split made when a quote is taken from a page.

    Needs ``origin_iata``, ``raw_total_fare``, ``raw_convenience_fee`` (may be null),
    ``travel_date`` and the two clock times; adds the raw parts and the duration. All
    amounts are decimals, so base absorbs the rounding exactly.
    """
    money = MONEY.simpleString()
    total = F.col("raw_total_fare").cast(money)
    fee = F.coalesce(F.col("raw_convenience_fee"), F.lit(0)).cast(money)
    udf_col = lookup("origin_iata", C.UDF_EXTRACTION if udf is None else udf, udf_default).cast(money)
    psf = F.lit(C.PSF).cast(money)
    pool = F.greatest(F.lit(0).cast(money), (total - udf_col - psf - fee).cast(money))
    taxable = F.bround(pool / F.lit("1.05").cast("decimal(3,2)"), 2).cast(money)
    base = F.bround(taxable * F.lit("0.70").cast("decimal(3,2)"), 2).cast(money)
    fuel = F.bround(taxable * F.lit("0.30").cast("decimal(3,2)"), 2).cast(money)
    gst = (pool - base - fuel).cast(money)
    rest = (total - base - fuel - gst - udf_col - psf - fee).cast(money)
    minutes = text.minute_of_day("arrival_time") - text.minute_of_day("departure_time")
    return df.withColumns({
        "raw_base_fare": (base + rest).cast(money), "raw_fuel_surcharge": fuel, "raw_taxes": gst,
        "raw_udf": udf_col, "raw_psf": psf, "raw_convenience_fee": fee,
        "duration_minutes": F.when(minutes > 0, F.greatest(F.lit(45), minutes)).otherwise(120).cast("int"),
    })
