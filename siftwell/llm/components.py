"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.runtime import discard, materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node.

    Each round takes the least label among a node's neighbours (a partial aggregate, so a node
    with very many links is combined before the shuffle) and then jumps to the label's label.
    Labels are written to the shared folder each round; only a changed-row count reaches the driver.
    Nulls and self-links are ignored; an empty edge list gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    links = materialize(e.union(e.select("b", "a")).distinct(), "links")
    labels = materialize(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        near = (
            links.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("up"))
        new = materialize(step.join(jump, "mid", "left").select("node", F.least("mid", "up").alias("component"), "old"), "labels")
        changed = new.where("component <> old").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(links)
            return labels.select("node", "component")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def link_in_rounds(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = 2, last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of nodes that verified links join, links being sought among the holders of a bucket.

    entries: bucket, node.  verify takes pairs (a, b), a < b, and keeps the true ones.  In each of the first
    rounds every holder of a bucket is paired with one of its holders (first the one that meets most others in its
    buckets, the middle of a group of edited copies; then another), so a bucket of n holders makes n pairs; the last round pairs whatever holders of a bucket still lie in different components.  Buckets that
    lie in one component drop out, and no pair is verified twice.  The pairs of the last round grow with the square of a
    group of copies whose edits keep them just short of the threshold; `last`, where given, makes that round without a row
    per pair: it takes (bucket, node, comp) and gives true links (a, b) that join what can be joined within each bucket.
    """
    found = tried = labels = None
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("met"))
    met_by = entries.join(sizes, "bucket").groupBy("node").agg(F.sum("met").alias("met"))
    entries = materialize(entries.join(met_by, "node"), "entries")
    for step in range(rounds + 1):
        e = entries.withColumn("comp", F.col("node")) if labels is None else entries.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        mixed = e.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
        e = materialize(e.join(mixed, "bucket", "left_semi"), "mixed")
        if step and not e.limit(1).count():
            break
        entries = e.drop("comp")
        if step == rounds and last:
            return connected_components(found.union(materialize(last(e.select("bucket", "node", "comp")), "linked")), "a", "b")
        if step < rounds:
            lead = e.groupBy("bucket").agg(F.min_by(F.struct("node", "comp"), F.struct(F.lit(0) if step else -F.col("met"), F.xxhash64("node", F.lit(step)))).alias("lead")).select("bucket", "lead.*")
            met = e.alias("l").join(lead.alias("r"), "bucket").where("l.comp <> r.comp")
        else:
            met = e.alias("l").join(e.alias("r"), "bucket").where("l.comp < r.comp")
        pairs = met.selectExpr("least(l.node, r.node) as a", "greatest(l.node, r.node) as b").distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        good = materialize(verify(pairs), "linked")
        found, tried = (good, pairs) if found is None else (found.union(good), tried.union(pairs))
        labels = connected_components(found, "a", "b")
    return labels
