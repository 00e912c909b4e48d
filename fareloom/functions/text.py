"""Codes, flight numbers, times of day and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fareloom import constants as C

IATA_PATTERN = "^[A-Z]{3}$"
SECTOR_PATTERN = "^[A-Z]{3}-[A-Z]{3}$"
TIME_PATTERN = r"(?:^|[^0-9A-Za-z_])((?:[01]?[0-9]|2[0-3]):[0-5][0-9])(?:[^0-9A-Za-z_]|$)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def code(value: Column | str) -> Column:
    """Upper case without surrounding blanks."""
    return F.upper(F.trim(_col(value)))


def source_name(value: Column | str) -> Column:
    return F.lower(F.trim(_col(value)))


def valid_iata(value: Column | str) -> Column:
    return F.coalesce(code(value).rlike(IATA_PATTERN), F.lit(False))


def valid_sector(value: Column | str) -> Column:
    return F.coalesce(code(value).rlike(SECTOR_PATTERN), F.lit(False))


def normalize_flight(value: Column | str) -> Column:
    """Letters and digits only, upper case."""
    return F.regexp_replace(F.upper(_col(value)), "[^A-Z0-9]", "")


def window_days(value: Column | str) -> Column:
    """P10: ``T+7``, ``T_7``, ``7`` -> 7; null when it is not a basket window."""
    days = F.regexp_extract(code(value.cast("string") if isinstance(value, Column) else F.col(value).cast("string")),
                            r"^(?:T[+_])?([0-9]+)$", 1).try_cast("int")
    return F.when(days.isin(C.WINDOWS), days)


def clock_time(value: Column | str, default: str | None = "08:00") -> Column:
    """The first ``H:MM`` of a text as ``HH:mm``."""
    found = F.lpad(F.regexp_extract(_col(value), TIME_PATTERN, 1), 5, "0")
    found = F.when(found != "00000", found)
    return found if default is None else F.coalesce(found, F.lit(default))


def minute_of_day(value: Column | str) -> Column:
    """Minutes since midnight of ``HH:mm``."""
    value = _col(value)
    return F.substring(value, 1, 2).try_cast("int") * 60 + F.substring(value, 4, 2).try_cast("int")


def at_time(day: Column | str, clock: Column | str) -> Column:
    """A date and an ``HH:mm`` text as one timestamp."""
    return F.to_timestamp(F.concat_ws(" ", _col(day).cast("string"), _col(clock)), "yyyy-MM-dd HH:mm")


def reporting_lead_time(days: Column | str) -> Column:
    """Snap any lead time to a basket window."""
    days = _col(days)
    return (F.when(days <= 1, 1).when(days <= 7, 7).when(days <= 15, 15)
            .when(days <= 30, 30).when(days.isNotNull(), 45))


def row_key(*columns: Column | str) -> Column:
    """A stable id from the row's own values."""
    return F.md5(F.concat_ws("|", *[_col(c).cast("string") for c in columns]))


def hash_number(value: Column | str) -> Column:
    """The first eight hex digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(_col(value)), 1, 8), 16, 10).cast("bigint")


def months_between_inclusive(first: Column, last: Column) -> Column:
    """Array of month starts from ``first`` to ``last``."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
