"""Hosts against tables of domain suffixes, as an equi-join on exploded dot-suffixes.

Catalyst would run an endswith join as a nested loop.  Exploding a host gives as many rows as it has labels;
the join is then on equality and Spark broadcasts the suffix table only where it is under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.web import suffixes


def longest_suffix(rows: DataFrame, host: str, table: DataFrame, suffix: str, value: str, out: str, own_name: bool = False) -> DataFrame:
    """rows with the value of the longest listed suffix ('.com.eg' before '.eg') as out, NULL if none.  With
    own_name the whole host counts as well, listed without a leading dot."""
    hosts = rows.select(host).distinct()
    forms = F.transform(suffixes(F.col(host)), lambda s: F.substring(s, 2, 10_000) if own_name else s)
    forms = F.array_append(forms, F.col(host)) if own_name else forms
    pieces = hosts.select(host, F.explode(forms).alias("_s"))
    dim = table.select(F.col(suffix).alias("_s"), F.col(value).alias("_v"))
    found = pieces.join(dim, "_s").groupBy(host).agg(F.max_by("_v", F.length("_s")).alias(out))
    return rows.join(found, host, "left")
