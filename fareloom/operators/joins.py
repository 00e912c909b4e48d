"""Joins of facts to a cohort table, which is small almost always but never assumed to be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareloom.session import stored

MAX_BROADCAST_ROWS = 100_000


def join_cohort(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner",
                max_rows: int = MAX_BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """``rows`` joined to ``side``, which has one row per value of ``keys``.

    The side is written once and counted. Up to ``max_rows`` rows it is broadcast, so that
    facts are not shuffled on a few cohort keys; beyond that it is copied once for each of
    ``salts`` values, so that no cohort's facts meet in one task.
    """
    side, keys = stored(side, "cohorts"), list(keys)
    if side.count() <= max_rows:
        return rows.join(F.broadcast(side), keys, how)
    plain = [c for c, kind in rows.dtypes if "map<" not in kind]
    salt = F.pmod(F.xxhash64(*plain), F.lit(salts))
    copies = side.withColumn("join_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = rows.withColumn("join_salt", salt).join(copies, [*keys, "join_salt"], how)
    return joined.drop("join_salt")
