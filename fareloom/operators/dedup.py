"""One quote per flight, and the fare of the day before."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions import text
from fareloom.operators.joins import MAX_BROADCAST_ROWS
from fareloom.operators.ranking import HEAVY_ROWS, heavy_hashes
from fareloom.session import stored

FLIGHT_KEY = ["origin_iata", "destination_iata", "carrier_code", "flight_key", "travel_date"]


def with_flight_key(df: DataFrame) -> DataFrame:
    """``flight_key``, which with the codes (as P1 leaves them) makes the canonical key."""
    return df.withColumn("flight_key", text.normalize_flight(F.coalesce("flight_number", F.lit(""))))


def flight_columns() -> list[Column]:
    """``FLIGHT_KEY`` as expressions of a quote's columns."""
    return [text.normalize_flight(F.coalesce("flight_number", F.lit(""))) if c == "flight_key" else F.col(c) for c in FLIGHT_KEY]


def deduplicate_quotes(
    df: DataFrame, fare: str | Column = "raw_total_fare", scope_cols: Sequence[str] = (),
    order: Sequence[str] = ("scrape_timestamp", "quote_id"), deal_first: bool = False, most_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Direct source first, then lowest fare, then first seen.

    The reference key leaves out lead time, so quotes of one flight seen weeks apart
    collapse; pass ``scope_cols=["advance_days"]`` (or a scrape date) to keep them apart.
    ``row_number() = 1`` is cut to one row per key in every map task before the shuffle,
    so a key with a third of all rows costs no more than any other.

    That cut sorts each map task's rows, which spills where a task reads many. With
    ``deal_first`` whole rows are dealt by key and sorted once, in the smaller parts they are
    dealt to; keys in hashes of over ``most_rows`` rows, which a count tells first, keep to the cut.
    """
    names = [*FLIGHT_KEY, *scope_cols]
    if not deal_first:
        return _first(with_flight_key(df), names, fare, order)
    dealt, heavy = heavy_hashes(df, [*flight_columns(), *scope_cols], most_rows)
    light = df.filter(~dealt.isin(heavy)) if heavy else df
    light = _first(with_flight_key(light).repartition(*names), names, fare, order)
    return light.unionByName(_first(with_flight_key(df.filter(dealt.isin(heavy))), names, fare, order)) if heavy else light


def _first(keyed: DataFrame, keys: Sequence[str], fare: str | Column, order: Sequence[str]) -> DataFrame:
    agency = F.when(text.source_name("source").isin(C.DIRECT_SOURCES), 0).otherwise(1)
    first = Window.partitionBy(*keys).orderBy(agency, fare, *order)
    return (keyed.withColumn("choice", F.row_number().over(first)).filter(F.col("choice") == 1)
            .drop("choice", "flight_key"))


def settled(df: DataFrame, keys: Sequence[str | Column], settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``settle``, which leaves rows whose ``keys`` occur once as they are, without a shuffle of those.

    Only 64-bit hashes of the keys are shuffled, to count them; rows whose hash occurs again
    are settled, be their keys equal or not. ``df`` is read several times. Where very many
    keys repeat, all rows are settled.
    """
    at = F.xxhash64(*keys)
    repeated = df.groupBy(at.alias("key_hash")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key_hash")
    repeated = stored(repeated, "repeated-keys")
    found = repeated.count()
    if found > MAX_BROADCAST_ROWS:
        return settle(df)
    if not found:
        return df
    hashed, repeated = df.withColumn("key_hash", at), F.broadcast(repeated)
    once = hashed.join(repeated, "key_hash", "left_anti").drop("key_hash")
    return once.unionByName(settle(hashed.join(repeated, "key_hash", "left_semi").drop("key_hash")))


def cheapest_quote(
    df: DataFrame, keys: Sequence[str], fare: str = "total_fare", tie: str = "quote_id",
) -> DataFrame:
    """Least fare per key and the quote that has it, as one aggregate."""
    return df.groupBy(*keys).agg(
        F.min_by(F.col(tie), F.struct(fare, tie)).alias(tie), F.min(fare).alias(fare),
    )


def previous_day_fare(
    df: DataFrame, fare: str = "raw_total_fare", ts: str = "scrape_timestamp", tie: str = "quote_id",
    name: str = "prev_fare",
) -> DataFrame:
    """Fare of the same flight, travel date and source on its last earlier scrape day.

    One window over a flight's quotes, by a frame that ends the day before: the rows are read
    and shuffled once. Rows whose key or scrape day is unknown have no earlier day.
    """
    key = [*FLIGHT_KEY, "source"]
    keyed = with_flight_key(df).withColumn("scrape_day", F.to_date(ts))
    before = Window.partitionBy(*key).orderBy(F.unix_date("scrape_day")).rangeBetween(Window.unboundedPreceding, -1)
    # the last quote of the last day: the greatest (day, time, tie)
    last = F.max(F.struct("scrape_day", F.col(ts).alias("at"), F.col(tie).alias("tie"), F.col(fare).cast("double").alias("day_fare")))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, "scrape_day"]])
    return keyed.withColumn(name, F.when(known, last.over(before)["day_fare"])).drop("scrape_day", "flight_key")
