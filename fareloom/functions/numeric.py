"""Rounding, logs and literal lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TIE_SLACK = 1e-7


def to_places(value: Column | str, places: int) -> Column:
    """Round half up, treating values within 1e-7 of a unit in the last place as ties.

    Sums of doubles come out in a different order on every run of a distributed
    aggregate; the slack keeps a mean that is exactly half a unit from flipping.
    """
    value = F.col(value) if isinstance(value, str) else value
    scale = 10**places
    return F.floor(value * F.lit(float(scale)) + F.lit(0.5 + TIE_SLACK)) / F.lit(float(scale))


def half_even(value: Column | str, places: int) -> Column:
    """Banker's rounding, for published levels."""
    return F.bround(value, places)


def double_of(text: Column | str) -> Column:
    """A double, or null where the text is none (never an error)."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("double")


def lookup(key: Column | str, table: Mapping, default=None, kind: str = "double") -> Column:
    """Value of a small fixed table as an expression, so no join is planned."""
    key = F.col(key) if isinstance(key, str) else key
    if not table:
        return F.lit(default).cast(kind)
    entries = []
    for k, v in table.items():
        entries += [F.lit(k), F.lit(v).cast(kind)]
    found = F.element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def geometric_mean(value: Column | str) -> Column:
    """exp(mean ln p) over the positive values; null when there is none."""
    value = F.col(value) if isinstance(value, str) else value
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def pct_change(now: Column, before: Column, places: int = 2) -> Column:
    """Percentage change, 0 where the earlier value is not positive, null where absent."""
    return F.when(before > 0, to_places((now / before - 1.0) * 100.0, places)).when(
        before.isNotNull(), F.lit(0.0)
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
