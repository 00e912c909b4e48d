"""Exact ranks and quantiles that hold when one group has most of the rows.

``percentile`` and ``row_number`` send a whole group to one task. Here groups are cut
into slices that keep the order of the values: slice sizes come from a map-side
combined count, a running sum over the (few) slices of a group gives each slice its
starting rank, and only then are rows ranked, slice by slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.operators.joins import join_cohort
from fareloom.session import stored

SLICES_PER_OCTAVE = 32
DEALT = 1 << 16  # hashes by which rows are counted before they are dealt
HEAVY_ROWS = 1_000_000  # a hash with more rows than these is not left to one task


def value_slice(value: Column) -> Column:
    """A slice number that never falls as the value rises (about 2 % of the value wide)."""
    size = F.floor(F.log2(F.abs(value) + 1.0) * SLICES_PER_OCTAVE)
    return F.when(value < 0, -size).otherwise(size).cast("int")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): equal values fold together before the shuffle."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n")))


def _slice_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, slice, slice_rows, rows_before, rows): one row per non-empty slice."""
    per_slice = counts.groupBy(*keys, "slice").agg(F.sum("n").alias("slice_rows"))
    group = Window.partitionBy(*keys)
    return per_slice.select(
        *keys, "slice", "slice_rows",
        (F.sum("slice_rows").over(group.orderBy("slice")) - F.col("slice_rows")).alias("rows_before"),
        F.sum("slice_rows").over(group).alias("rows"),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count_as: str = "n",
) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per entry of ``probs``.

    Only the slices that hold a wanted rank are ranked, so the last sort sees a small
    part of the distinct values however large the group is.
    """
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs, count_as)


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count_as: str = "n", folded: bool = True,
) -> DataFrame:
    """The same from (keys, value, n), one row for each distinct value of a group.

    Where ``counts`` are not ``folded``, a value may have several rows, whose (signed) counts
    add up. Then slices are counted in the map tasks, and only values in slices that hold a
    wanted rank are shuffled; ``counts`` are read twice.
    """
    keys = list(keys)
    counts = counts.withColumn("slice", value_slice(F.col(value)))
    wanted = _slice_offsets(counts, keys)
    hit = F.lit(False)
    for name, p in probs.items():
        position = F.lit(p) * (F.col("rows") - 1)
        wanted = (wanted.withColumn(f"{name}__low", F.floor(position))
                  .withColumn(f"{name}__high", F.ceil(position))
                  .withColumn(f"{name}__part", position - F.floor(position)))
        for end in ("low", "high"):
            rank = F.col(f"{name}__{end}")
            hit = hit | ((rank >= F.col("rows_before"))
                         & (rank < F.col("rows_before") + F.col("slice_rows")))
    wanted = wanted.filter(hit)
    within = Window.partitionBy(*keys, "slice").orderBy(value)
    if folded:
        held = counts.join(wanted, [*keys, "slice"])
    else:
        place = [*keys, "slice"]
        wanted = stored(wanted, "wanted-slices")
        few = join_cohort(counts, wanted.select(*place), place).groupBy(*place, value).agg(F.sum("n").alias("n")).filter("n <> 0")
        held = join_cohort(few, wanted, place)
    ranked = (held
              .withColumn("rank_end", F.col("rows_before") + F.sum("n").over(within))
              .withColumn("rank_start", F.col("rank_end") - F.col("n")))
    aggregates = [F.max("rows").alias(count_as)]
    for name in probs:
        for end in ("low", "high"):
            rank = F.col(f"{name}__{end}")
            inside = (rank >= F.col("rank_start")) & (rank < F.col("rank_end"))
            aggregates.append(F.max(F.when(inside, F.col(value))).alias(f"{name}_{end}"))
        aggregates.append(F.max(f"{name}__part").alias(f"{name}_part"))
    found = ranked.groupBy(*keys).agg(*aggregates)
    return found.select(*keys, count_as, *[
        (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")).alias(name)
        for name in probs
    ])


def approx_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], count_as: str = "n",
    accuracy: int = 10_000,
) -> DataFrame:
    """The sketch form: one shuffle, a bounded error."""
    found = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count_as),
        F.percentile_approx(value, list(probs.values()), accuracy).alias("q"),
    )
    return found.select(*keys, count_as, *[F.col("q")[i].cast("double").alias(n) for i, n in enumerate(probs)])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, rank_as: str = "rank") -> DataFrame:
    """(keys, value, n, rank): competition rank of each distinct value in its group."""
    keys = list(keys)
    counts = value_counts(df, keys, value).withColumn("slice", value_slice(F.col(value)))
    offsets = _slice_offsets(counts, keys).select(*keys, "slice", "rows_before")
    within = Window.partitionBy(*keys, "slice").orderBy(value)
    return counts.join(offsets, [*keys, "slice"]).select(
        *keys, value, "n",
        (F.col("rows_before") + F.sum("n").over(within) - F.col("n") + 1).alias(rank_as),
    )


def heavy_hashes(df: DataFrame, keys: Sequence[str | Column], most_rows: int = HEAVY_ROWS) -> tuple[Column, list[int]]:
    """The hash rows are counted by, and which of its values hold over ``most_rows`` rows (a few at most)."""
    dealt = F.pmod(F.xxhash64(*keys), F.lit(DEALT))
    return dealt, [r[0] for r in df.groupBy(dealt.alias("dealt")).count().filter(F.col("count") > most_rows).select("dealt").collect()]


def occurrence_no(
    df: DataFrame, keys: Sequence[str], day: str, tie: str, name: str = "occurrence", near: Sequence[str] | None = None,
    most_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Number the rows of each group 1, 2, … in order of ``day``, then ``tie``.

    Rows are dealt by ``near``, which is all or some of ``keys``: a caller who goes on by
    those columns gets the rows as they lie, without a further shuffle. A count of rows by
    hashes of ``near`` first tells which of them hold over ``most_rows`` rows; their groups
    are numbered stretch by stretch, so no task gets a group of any size.
    """
    near = list(near or keys)
    dealt, heavy = heavy_hashes(df, near, most_rows)
    light = df.filter(~dealt.isin(heavy)) if heavy else df
    group = Window.partitionBy(*keys).orderBy(day, tie)
    light = light.repartition(*near).withColumn(name, F.row_number().over(group).cast("bigint"))
    return light.unionByName(_numbered_by_stretch(df.filter(dealt.isin(heavy)), list(keys), day, tie, name)) if heavy else light


def _numbered_by_stretch(df: DataFrame, keys: list[str], day: str, tie: str, name: str) -> DataFrame:
    """The same for groups of any size.

    The rows are range-partitioned by (keys, day, tie),
    so a group with most of the rows spans many stretches. Each stretch numbers its own rows
    and adds the group's rows in earlier stretches. The stretches are written to the scratch
    folder, so that counts and rows see the same cut. Where they are cut differs between
    runs, the numbers do not.
    """
    order = list(dict.fromkeys([*keys, day, tie]))
    cut = stored(df.repartitionByRange(*order).withColumn("stretch", F.spark_partition_id()), "stretches")
    counts = cut.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("rows"))
    # a group has a row for each stretch it spans, one for almost all groups
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    spanning = counts.withColumn("rows_before", F.sum("rows").over(earlier)).filter("rows_before is not null")
    own = Window.partitionBy(*keys, "stretch").orderBy(day, tie)
    joined = cut.withColumn("own", F.row_number().over(own))
    before = spanning.select(*[F.col(k).alias(f"{k}__s") for k in [*keys, "stretch"]], "rows_before")
    same = [F.col(k).eqNullSafe(F.col(f"{k}__s")) for k in [*keys, "stretch"]]
    match = same[0]
    for part in same[1:]:
        match = match & part
    return joined.join(before, match, "left").select(
        *df.columns, (F.coalesce("rows_before", F.lit(0)) + F.col("own")).cast("bigint").alias(name))
