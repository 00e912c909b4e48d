"""Rolling multilateral series and splicing.

Everything here works on series of periods (a few hundred rows each), never on quotes.
The GEKS vectors of all windows of all series come from one aggregate; the splice, which
is sequential because each value rests on rounded earlier ones, is a fold over one array
per series, run by the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.functions.numeric import to_places

SPLICES = ("mean", "movement", "window", "half")
BLOCK = 100  # published rows of a series that are laid down together


def number_periods(levels: DataFrame, series: str = "series_id", period: str = "period") -> DataFrame:
    """Dense period number from 0 within each series."""
    order = Window.partitionBy(series).orderBy(period)
    return levels.withColumn("idx", F.row_number().over(order) - 1)


def bilateral_pairs(levels: DataFrame, length: int, series: str = "series_id", period: str = "period") -> DataFrame:
    """(series, p_from, p_to, i, j, rel) for periods less than ``length`` apart.

    Offsets are exploded and joined on the shifted number, so it is an equi-join.
    """
    numbered = number_periods(levels, series, period).select(series, period, "idx", "level")
    offsets = F.array(*[F.lit(d) for d in range(-(length - 1), length)])
    left = numbered.select(series, F.col(period).alias("p_from"), F.col("idx").alias("i"),
                           F.col("level").alias("level_from"), F.explode(offsets).alias("d"))
    left = left.withColumn("j", F.col("i") + F.col("d")).drop("d")
    right = numbered.select(series, F.col(period).alias("p_to"), F.col("idx").alias("j"),
                            F.col("level").alias("level_to"))
    rel = F.when(F.col("level_from") > 0, F.col("level_to") / F.col("level_from")).otherwise(1.0)
    return left.join(right, [series, "j"]).select(series, "p_from", "p_to", "i", "j", rel.alias("rel"))


def geks_vector(bilateral: DataFrame, series: str = "series_id") -> DataFrame:
    """A11 on full matrices: ln g_t = mean_k(ln P[k,t] − ln P[k,first]), g_first = 1."""
    columns = bilateral.groupBy(series, "p_to").agg(F.avg(F.ln("rel")).alias("m"))
    order = Window.partitionBy(series).orderBy("p_to")
    return columns.select(series, F.col("p_to").alias("period"),
                          F.exp(F.col("m") - F.first("m").over(order)).alias("geks"))


def geks_pairwise(bilateral: DataFrame, base, current, series: str = "series_id") -> DataFrame:
    """A12 for one pair of periods; a missing relative counts as 1."""
    members = bilateral.select(series, F.explode(F.array("p_from", "p_to")).alias("k")).distinct()
    to = bilateral.select(series, F.col("p_from").alias("k"), "p_to", "rel")
    now = to.filter(F.col("p_to") == F.lit(current)).select(series, "k", F.col("rel").alias("now"))
    was = to.filter(F.col("p_to") == F.lit(base)).select(series, "k", F.col("rel").alias("was"))
    joined = members.join(now, [series, "k"], "left").join(was, [series, "k"], "left")
    one = F.lit(1.0)
    return joined.groupBy(series).agg(
        F.exp(F.avg(F.ln(F.coalesce("now", one)) - F.ln(F.coalesce("was", one)))).alias("geks"))


def complete_relatives(pairwise: DataFrame, series: str = "series_id") -> DataFrame:
    """Forward relatives (i < j) with their inverses and the diagonal, keyed by number."""
    forward = pairwise.filter(F.col("i") < F.col("j")).select(series, "i", "j", "rel")
    back = forward.select(series, F.col("j").alias("i"), F.col("i").alias("j"), (1.0 / F.col("rel")).alias("rel"))
    return forward.unionByName(back)


def rolling_geks(numbered: DataFrame, pairwise: DataFrame, length: int, series: str = "series_id") -> DataFrame:
    """W5 + A11: (series, t, g) with the GEKS vector of the window that ends at each t.

    A relative that is missing goes by way of the window's first period, and is 1 where
    that is missing too.
    """
    size = F.greatest(F.lit(0), F.col("idx") - (length - 1))
    window = numbered.select(series, F.col("idx").alias("t"), size.alias("first"))
    span = F.sequence("first", "t")
    cells = (window.withColumn("i", F.explode(span)).withColumn("j", F.explode(span)))
    rels = complete_relatives(pairwise, series)

    def joined(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        return df.join(rels.select(series, F.col("i").alias(a), F.col("j").alias(b), F.col("rel").alias(name)),
                       [series, a, b], "left")

    cells = joined(cells, "i", "j", "direct")
    via = rels.select(series, F.col("i").alias("first"), "j", F.col("rel").alias("to_j"))
    cells = cells.join(via, [series, "first", "j"], "left")
    cells = cells.join(via.select(series, "first", F.col("j").alias("i"), F.col("to_j").alias("to_i")),
                       [series, "first", "i"], "left")
    one = F.lit(1.0)
    rel = F.when(F.col("i") == F.col("j"), one).otherwise(
        F.coalesce("direct", F.coalesce("to_j", one) / F.coalesce("to_i", one)))
    means = cells.groupBy(series, "t", "j").agg(F.avg(F.ln(rel)).alias("m"))
    vector = means.groupBy(series, "t").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("ms"))
    return vector.select(series, "t", F.transform(
        "ms", lambda e: F.exp(e["m"] - F.get("ms", F.lit(0))["m"])).alias("g"))


def _spliced(published: Column, g: Column, method: str) -> tuple[Column, Column]:
    """(value, factor) of a window on the last size(g) − 1 published values."""
    n = F.size(g)
    history = F.slice(published, F.size(published) - n + 2, n - 1)
    last = F.get(g, n - 1)
    if method == "mean":
        gaps = F.zip_with(history, F.slice(g, F.lit(1), n - 1), lambda p, x: F.ln(p) - F.ln(x))
        factor = F.exp(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / (n - 1))
        return last * factor, factor
    movement = F.get(history, n - 2) * last / F.get(g, n - 2)
    oldest = F.get(history, F.lit(0)) * last / F.get(g, F.lit(0))
    value = {"movement": movement, "window": oldest, "half": F.sqrt(movement * oldest)}[method]
    return value, value / last


def splice(vectors: DataFrame, method: str = "mean", base_value: float = 100.0, series: str = "series_id") -> DataFrame:
    """(series, t, published, factor, window_length); earlier values are never revised.

    A fold over the windows of a series. A step reads the last values only, which it keeps
    in a ring as long as the longest window; what was published is laid down in blocks, so
    that a step costs the same however long the series is.
    """
    if method not in SPLICES:
        raise ValueError(f"unknown splice method: {method}")
    ordered = vectors.groupBy(series).agg(F.array_sort(F.collect_list(F.struct("t", "g"))).alias("windows"))
    ordered = ordered.withColumn("longest", F.array_max(F.transform("windows", lambda w: F.size(w["g"]))))

    def step(done: Column, window: Column) -> Column:
        value, factor = _spliced(done["ring"], window["g"], method)
        first = F.size(done["ring"]) == 0
        row = F.struct(
            window["t"].alias("t"),
            F.when(first, F.lit(base_value)).otherwise(to_places(value, 4)).alias("published"),
            F.when(first, F.lit(1.0)).otherwise(to_places(factor, 6)).alias("factor"),
            F.size(window["g"]).alias("window_length"),
        )
        return F.get(F.transform(F.array(row), lambda r: _laid(done, r)), F.lit(0))  # the row is computed once

    def _laid(done: Column, row: Column) -> Column:
        ring, block = F.concat(done["ring"], F.array(row["published"])), F.concat(done["block"], F.array(row))
        full = F.size(done["block"]) >= BLOCK - 1
        return F.struct(
            F.when(F.size(ring) > F.col("longest"), F.slice(ring, 2, F.col("longest"))).otherwise(ring).alias("ring"),
            F.when(full, F.slice(block, 1, 0)).otherwise(block).alias("block"),
            F.when(full, F.concat(done["blocks"], F.array(block))).otherwise(done["blocks"]).alias("blocks"),
        )

    rows = "array<struct<t:int,published:double,factor:double,window_length:int>>"
    empty = F.expr(f"cast(named_struct('ring',array(),'block',array(),'blocks',array()) as struct<ring:array<double>,block:{rows},blocks:array<{rows}>>)")
    return ordered.select(series, F.inline(F.aggregate(
        "windows", empty, step, lambda done: F.concat(F.flatten(done["blocks"]), done["block"]))))


def rygeks_series(
    levels: DataFrame | None = None, pairwise: DataFrame | None = None, periods: DataFrame | None = None,
    length: int = 13, method: str = "mean", base_value: float = 100.0,
    series: str = "series_id", period: str = "period",
) -> DataFrame:
    """The published series, from levels or from pairwise relatives.

    ``levels``: series, period, level. ``pairwise``: series, p_from, p_to, rel, with
    ``periods`` (series, period) giving the calendar; a missing relative is 1.
    """
    if length < 2:
        raise ValueError("window length must be at least 2")
    if pairwise is None:
        numbered = number_periods(levels, series, period).select(series, period, "idx")
        pairs = bilateral_pairs(levels, length + 1, series, period)
    else:
        numbered = number_periods(periods, series, period).select(series, period, "idx")
        ids = numbered.select(series, F.col(period).alias("p_from"), F.col("idx").alias("i"))
        pairs = (pairwise.join(ids, [series, "p_from"])
                 .join(ids.select(series, F.col("p_from").alias("p_to"), F.col("i").alias("j")), [series, "p_to"]))
    folded = splice(rolling_geks(numbered, pairs, length, series), method, base_value, series)
    return folded.join(numbered.withColumnRenamed("idx", "t"), [series, "t"]).select(
        series, period, F.col("published").alias("published_index"), "window_length",
        F.when(F.col("t") == 0, "base").otherwise(method).alias("splice_method"),
        F.col("factor").alias("level_adjustment_factor"),
        ((F.col("t") + 1) < length).alias("is_expanding_window"),
    )


def bilateral_from_cohorts(
    cohorts: DataFrame, weights: DataFrame, length: int, keys: Sequence[str], period: str = "period",
    series: str = "series_id",
) -> DataFrame:
    """True bilateral relatives between period pairs, from one row per (period, cohort).

    ``cohorts``: series, period, idx, keys, log_mean; ``weights``: keys, weight. A pair's
    relative is the weighted mean log change over the cohorts both periods have. Quotes
    are reduced to cohort means first, so the pairing multiplies a small table.
    """
    offsets = F.array(*[F.lit(d) for d in range(1, length)])
    later = cohorts.select(series, *keys, F.col(period).alias("p_to"), F.col("idx").alias("j"),
                           F.col("log_mean").alias("log_to"), F.explode(offsets).alias("d"))
    later = later.withColumn("i", F.col("j") - F.col("d")).drop("d")
    earlier = cohorts.select(series, *keys, F.col(period).alias("p_from"), F.col("idx").alias("i"),
                             F.col("log_mean").alias("log_from"))
    pairs = later.join(earlier, [series, *keys, "i"]).join(weights, list(keys))
    return pairs.groupBy(series, "p_from", "p_to", "i", "j").agg(
        F.exp(F.sum(F.col("weight") * (F.col("log_to") - F.col("log_from"))) / F.sum("weight")).alias("rel"))


def chain_drift(bilateral: DataFrame, series: str = "series_id") -> DataFrame:
    """Chained index over consecutive periods against GEKS from first to last."""
    ends = bilateral.groupBy(series).agg(F.min("i").alias("lo"), F.max("j").alias("hi"))
    forward = bilateral.filter(F.col("j") == F.col("i") + 1).groupBy(series).agg(
        F.exp(F.sum(F.ln("rel"))).alias("chained"))
    columns = bilateral.groupBy(series, F.col("j")).agg(F.avg(F.ln("rel")).alias("m"))
    joined = columns.join(ends, series)
    geks = joined.groupBy(series).agg(F.exp(
        F.max(F.when(F.col("j") == F.col("hi"), F.col("m")))
        - F.max(F.when(F.col("j") == F.col("lo"), F.col("m")))).alias("geks"))
    return forward.join(geks, series).withColumn("drift", F.col("chained") - F.col("geks"))
