"""Mix sources to target weights.

Sizes (words) are summed per source, each source gets its share of all words by weight, and a
target stops at CAP times the source's size, what is above going to the others by weight.  A
document is emitted floor(rate) times, rate = target / source size, and once more with
probability equal to rate's fraction, drawn from a hash of its id and a seed.  A source has
SEEDS draws to choose from and takes the one whose words come nearest its target, so the mix
stays close where a source has few or very unequal documents.  Reruns agree.

Every step is a DataFrame expression: one partial aggregate per source before any shuffle, so a
source with a third of all rows costs one row per task; the table of rates, one row per source,
is written to scratch, and Spark broadcasts it only where its size on disk is under its threshold.

Null texts have size 0, a null source is a source of its own and comes last, a null id draws as the
text 'null', rows with one id draw alike, and an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.runtime import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def draw(id_col: str, seed: F.Column) -> F.Column:
    """Uniform number in [0, 1) from a row's id and a seed."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), seed.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """sized: id, source, size.  One row per source: source, source_size, target, copies (whole), fraction, seed."""
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fill", "rank")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    s = total.select("source", "source_size", rank.alias("rank"), w.alias("weight"))
    s = s.withColumn("fill", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (everything - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(by_fill))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("fill") >= F.col("level"), F.col("place"))).over(Window.partitionBy()))
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = s.withColumn("target", target).withColumn("rate", rate)
    s = s.select("source", "source_size", "target", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    s = materialize(s, "targets")
    tried = sized.join(s, sized["source"].eqNullSafe(s["source"])).select(
        s["source"], "target", "copies",
        *[(F.col("size") * (F.col("copies") + (draw("id", F.lit(k)) < F.col("fraction")).cast("long"))).alias(f"t{k}") for k in range(seeds)],
    )
    sums = tried.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(f"t{k}").alias(f"t{k}") for k in range(seeds)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]))["seed"]
    chosen = sums.select("source", best.alias("seed"))
    return materialize(s.join(chosen, s["source"].eqNullSafe(chosen["source"])).select(s["*"], "seed"), "rates")


def _with_copies(rows: DataFrame, id_col: str, source_col: str, rates: DataFrame) -> DataFrame:
    r = rates.select(*[F.col(c).alias(f"__mix_{c}") for c in rates.columns])
    out = rows.join(r, rows[source_col].eqNullSafe(r["__mix_source"]))
    return out.withColumn("__mix_n", F.col("__mix_copies") + (draw(id_col, F.col("__mix_seed")) < F.col("__mix_fraction")).cast("long"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) per document."""
    sized = materialize(sizes(docs), "sizes")
    rates = source_rates(sized, weights, cap)
    return _with_copies(sized, "id", "source", rates).select(
        F.col("id").alias("doc_id"), "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("size") * F.col("__mix_n")).alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed rows themselves: docs with each row as often as the mix takes it, columns unchanged."""
    rates = source_rates(materialize(sizes(docs), "sizes"), weights, cap)
    out = _with_copies(docs, "doc_id", "source", rates)
    return out.withColumn("__mix_k", F.explode(F.array_repeat(F.lit(1), F.col("__mix_n").cast("int")))).select(*docs.columns)
