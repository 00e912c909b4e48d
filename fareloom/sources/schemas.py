"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RAW_QUOTE = _struct(
    ("quote_id", T.StringType()), ("source", T.StringType()), ("source_type", T.StringType()),
    ("scrape_timestamp", T.TimestampType()), ("origin_iata", T.StringType()),
    ("destination_iata", T.StringType()), ("carrier_code", T.StringType()),
    ("flight_number", T.StringType()), ("departure_time", T.StringType()),
    ("arrival_time", T.StringType()), ("travel_date", T.DateType()),
    ("advance_days", T.IntegerType()), ("duration_minutes", T.IntegerType()),
    ("stops", T.IntegerType()), ("fare_class", T.StringType()), ("currency", T.StringType()),
    ("raw_base_fare", MONEY), ("raw_fuel_surcharge", MONEY), ("raw_taxes", MONEY),
    ("raw_udf", MONEY), ("raw_psf", MONEY), ("raw_convenience_fee", MONEY),
    ("raw_total_fare", MONEY), ("seats_available", T.IntegerType()),
    ("is_sold_out", T.BooleanType()),
)

# other names a raw quote may arrive under (alias -> column)
RAW_ALIASES = {
    "origin": "origin_iata", "destination": "destination_iata", "carrier": "carrier_code",
    "total_fare": "raw_total_fare", "base_fare": "raw_base_fare", "taxes": "raw_taxes",
    "udf": "raw_udf", "convenience_fee": "raw_convenience_fee",
}

# a raw JSON file: the declared columns plus their aliases, all optional
RAW_QUOTE_FILE = T.StructType(
    [T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.TimestampType, T.DateType)) else f.dataType)
     for f in RAW_QUOTE.fields]
    + [T.StructField(alias, T.StringType()) for alias in RAW_ALIASES]
    + [T.StructField(name, T.StringType()) for name in ("scrape_date", "search_datetime", "departure_datetime")]
)

FARE_PARTS = [
    "base_fare", "fuel_surcharge", "airport_taxes_gst",
    "user_dev_fee", "passenger_service_fee", "convenience_fee",
]

CLEAN_QUOTE = _struct(
    ("quote_id", T.StringType()), ("scrape_timestamp", T.TimestampType()),
    ("route_id", T.IntegerType()), ("carrier_id", T.IntegerType()), ("sector", T.StringType()),
    ("origin_iata", T.StringType()), ("destination_iata", T.StringType()),
    ("carrier_code", T.StringType()), ("source", T.StringType()), ("source_type", T.StringType()),
    ("travel_date", T.DateType()), ("advance_days", T.IntegerType()),
    ("flight_number", T.StringType()), ("departure_time", T.StringType()),
    ("arrival_time", T.StringType()), ("duration_minutes", T.IntegerType()),
    ("stops", T.IntegerType()), ("fare_class", T.StringType()), ("currency", T.StringType()),
    ("base_fare", T.DoubleType()), ("fuel_surcharge", T.DoubleType()),
    ("airport_taxes_gst", T.DoubleType()), ("user_dev_fee", T.DoubleType()),
    ("passenger_service_fee", T.DoubleType()), ("convenience_fee", T.DoubleType()),
    ("total_fare", T.DoubleType()), ("seats_available", T.IntegerType()),
    ("is_sold_out", T.BooleanType()), ("is_outlier", T.BooleanType()),
    ("outlier_reason", T.StringType()), ("data_quality_score", T.DoubleType()),
    ("is_quarantined", T.BooleanType()),
)

CPI_FILE = _struct(
    *[(name, T.StringType()) for name in (
        "base_year", "series", "year", "month", "state", "sector", "division", "group",
        "class", "sub_class", "item", "code", "index", "inflation", "imputation")]
)

DAILY_INDEX = _struct(
    ("computation_date", T.DateType()), ("sector", T.StringType()),
    ("carrier_code", T.StringType()), ("advance_window", T.IntegerType()),
    ("index_value", T.DoubleType()), ("quotes_count", T.LongType()), ("frequency", T.StringType()),
)
