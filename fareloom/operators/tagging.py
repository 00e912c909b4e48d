"""Entities and intent of plain-language queries, over a table of texts.

Words are matched whole, with the ASCII letters, digits and underscore as word
characters. Texts are read in full.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom import constants as C
from fareloom.functions.numeric import lookup

BEFORE, AFTER = "(?:^|[^a-z0-9_])", "(?:[^a-z0-9_]|$)"
SECTOR = f"{BEFORE}([a-z]{{3}})\\s*(?:-|to|/)\\s*([a-z]{{3}}){AFTER}"
WINDOW = f"(?:t\\+|{BEFORE})([0-9]{{1,2}})(?:\\s*days?|{AFTER})"
# the same for the search in tasks: what rejects a place soonest comes first, and neighbours are looked at, not taken
NOT_BEFORE, NOT_AFTER = "(?<![a-z0-9_])", "(?![a-z0-9_])"
SECTOR_FOUND = f"(?=[a-z]{{3}}\\s*(?:-|to|/)){NOT_BEFORE}[a-z]{{3}}\\s*(?:-|to|/)\\s*[a-z]{{3}}{NOT_AFTER}"
WINDOW_FOUND = f"(?=[0-9]){NOT_BEFORE}([0-9]{{1,2}})(?:\\s*days?|{NOT_AFTER})"


def whole_word(word: str) -> str:
    word = word.replace("+", "\\+")
    return f"{word}{NOT_AFTER}(?<![a-z0-9_]{word})"


def has_word(text: Column, word: str) -> Column:
    """Whole-word test; a plain search first spares most rows the pattern."""
    return F.contains(text, F.lit(word)) & text.rlike(whole_word(word))


def _cities(text: Column) -> Column:
    """Airports named in the text, in list order: cities first, then bare codes."""
    words = C.CITY_WORDS + [(row[0].lower(), row[0]) for row in C.AIRPORTS]
    found = F.concat_ws(",", *[F.when(has_word(text, w), F.lit(iata)) for w, iata in words])
    return F.array_distinct(F.split(F.nullif(found, F.lit("")), ","))


def tag_queries(df: DataFrame, text_col: str = "text", extra_index_words: Sequence[str] = ()) -> DataFrame:
    """Add origin, destination, sector, carrier_code, advance_window and intent."""
    df = df.withColumn("q", F.lower(F.trim(text_col)))
    q = F.col("q")
    airports = [row[0] for row in C.AIRPORTS]
    df = df.withColumns({"pair": F.upper(F.regexp_extract(q, SECTOR_FOUND, 0)), "cities": _cities(q)})
    df = df.withColumns({"pair_o": F.left("pair", F.lit(3)), "pair_d": F.right("pair", F.lit(3))})
    known = F.col("pair_o").isin(airports) & F.col("pair_d").isin(airports)
    named = F.col("cities")
    carrier = F.coalesce(*[F.when(has_word(q, w), F.lit(c)) for w, c in C.CARRIER_WORDS])
    days = F.regexp_extract(q, WINDOW_FOUND, 1).try_cast("int")
    df = df.withColumns({
        "origin": F.when(known, F.col("pair_o")).otherwise(F.get(named, F.lit(0))),
        "destination": F.when(known, F.col("pair_d")).otherwise(F.get(named, F.lit(1))),
        "carrier_code": carrier,
        "advance_window": F.when(days.isin(C.WINDOWS), days),
    })
    sector = F.when(F.col("origin").isNotNull() & F.col("destination").isNotNull(), F.concat_ws("-", "origin", "destination"))

    def any_of(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words])

    intent = F.lit(None).cast("string")
    for name, words in reversed(C.INTENT_WORDS):
        listed = [*words, *extra_index_words] if name == "index_query" else words
        fallback = intent if name != "carrier_comparison" else (
            F.when(F.col("origin").isNotNull(), "route_query").otherwise("general_overview"))
        intent = F.when(any_of(listed), name).otherwise(fallback)
    names = {c: n for c, n, *_ in C.CARRIERS}
    return df.withColumns({
        "sector": sector, "intent": intent, "carrier_name": lookup("carrier_code", names, None, "string"),
    }).drop("q", "pair", "pair_o", "pair_d", "cities")
