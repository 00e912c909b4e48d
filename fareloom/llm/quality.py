"""Host-level quality rules, with DataFrame functions only.

Each text is measured by itself and fails when it is too short or repeats itself. The
failures are counted by host (``source``), each host's failure rate is shrunk towards the
corpus by a beta prior fitted to all hosts, and a host whose shrunk rate is above the limit
takes its remaining documents with it.

Defined cases: a null text has no words and fails; a null host is a host of its own; equal
rows each count and each get their result; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import SPACE, let, row_key, stored

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules: documents with fewer words, or with more than this share of
    their words in repeated windows, fail; hosts with a shrunk failure rate above
    ``host_rate`` are rejected."""

    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    host_rate: float = 0.5


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the text, the first one included."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def starts(p: Column) -> Column:  # p: pairs (hash, position) in order, so that equal neighbours are repeats
        repeated = F.filter(p, lambda e, j: (F.get(p, j - 1)["h"] == e["h"]) | (F.get(p, j + 1)["h"] == e["h"]))
        return F.array_sort(F.transform(repeated, lambda e: e["i"]))

    def reach(s: Column) -> Column:  # each start adds what the next one does not cover
        own = F.transform(s, lambda a, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - a, F.lit(window))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        covered = let(pairs, lambda p: let(starts(p), reach))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(hashes(w), count)))


def measure(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> dict[str, Column]:
    """Columns of the base rules for each row of ``docs``."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, SPACE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words, rules.window),
    }


def failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def host_verdicts(base: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, rejected.

    The beta prior comes from the mean ``m`` and variance ``v`` of the hosts' raw rates by
    moments: strength ``m (1 - m) / v - 1``, held between 2 and 1000 so that hosts that are
    all alike, or of one kind each, still give a proper prior.
    """
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    # one row; its key is a constant, so that the join below is an equi-join with one row
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select(
        F.lit(1).alias("one"), "m",
        F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(2.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
        .otherwise(F.lit(1000.0)).alias("strength"))
    joined = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")  # a single row by construction
    shrunk = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return joined.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > rules.host_rate).alias("host_rejected"))


def judge(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: ``row_key``, id, host, measures, ``base_failed``, the host's figures and ``kept``."""
    ids = [row_key(doc_id, text).alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host")]
    parts = [c.alias(name) for name, c in measure(docs, rules, text).items()]
    base = docs.select(*ids, *parts)
    # the measures cost a pass over all texts: keep them for the two uses below
    base = stored(base.withColumn("base_failed", failed(rules)), "quality")
    hosts = host_verdicts(base, rules).withColumnRenamed("host", "host_")
    both = base.join(hosts, base["host"].eqNullSafe(hosts["host_"]), "left").drop("host_")
    return both.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` whose document and host pass, columns unchanged."""
    good = judge(docs, rules, doc_id, text, host).where("kept").select("row_key", F.col("host").alias("host_"))
    rows = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("row_key"), F.col(host).cast("string").alias("host"))
    return rows.join(good.distinct(), (rows["row_key"] == good["row_key"]) & F.col("host").eqNullSafe(F.col("host_")), "left_semi").select("row.*")
