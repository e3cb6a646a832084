"""Matches of a pattern with their places, in the JVM: texts are split at the matches, and the pieces' lengths give the places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches (or one group of each); no array element for null texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def starts(found: Column, pieces: Column) -> Column:
    """Code point offset of each match, from all matches and the pieces between them (one more than the matches)."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p")), first,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + F.length(x["p"]))).alias("out")),
        lambda acc: acc["out"],
    )
