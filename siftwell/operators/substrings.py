"""Pairs of rows in which one text holds another, found by an equi-join.

A needle stands in a text only if each of its runs of four characters does.  So a needle is sought by one such run of its own (the
one of least hash, so that common beginnings do not meet in one place), or by itself where it is shorter, among all runs of
up to four characters of the text; pairs that share it are checked.  Work grows with the lengths of the texts and with
the pairs that share a run, not with needles times texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 4


def runs_of(c: Column, most: int = RUN) -> Column:
    """The different runs of up to `most` characters of a text, and ''."""
    none = F.array().cast("array<string>")
    of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: c.substr(i, F.lit(k)))).otherwise(none)
    by_length = [of(k) for k in range(1, most + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *by_length))


def run_of(needle: Column, most: int = RUN) -> Column:
    """The run by which a needle is sought."""
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(F.length(needle) - (most - 1), F.lit(1))), lambda i: F.struct(F.xxhash64(needle.substr(i, F.lit(most))).alias("h"), needle.substr(i, F.lit(most)).alias("run")))
    return F.when(F.length(needle) <= most, needle).otherwise(F.array_min(hashed)["run"])


def holding(texts: DataFrame, needles: DataFrame, on: list[str], text: str, needle: str) -> DataFrame:
    """Rows of texts joined to rows of needles (equal in on, other columns named apart) whose needle their text holds.  Null texts hold
    nothing, a null needle is held by none, and '' is held by every text.  Neither side is broadcast: Spark takes the size of
    a text's runs for that of the text."""
    t = texts.where(F.col(text).isNotNull()).withColumn("_run", F.explode(runs_of(F.col(text))))
    n = needles.where(F.col(needle).isNotNull()).withColumn("_run", run_of(F.col(needle)))
    return t.hint("merge").join(n, [*on, "_run"]).where(F.contains(F.col(text), F.col(needle))).drop("_run")


def fragments(c: Column) -> Column:
    """All different substrings of a short text (a name, an address' local part)."""
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda k: c.substr(i, k))
    return F.when(F.length(c) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), ends)))).otherwise(F.array().cast("array<string>"))
