"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.store import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least neighbour of u, u itself included; the least is found by partial aggregation."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Every round's edges go to the shared folder. A hub's rows are never gathered: its
    least neighbour comes from partial aggregates and its edges meet it in a join that
    adaptive execution can split. Rounds end when the edges no longer change, after
    about log(n) squared of them at most.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    marks = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # an edge makes one row here at most, so repeats need not be dropped
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ranked = _with_least(large)
        small = ranked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialize(small)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if tuple(found) == marks and found[0] == found[2]:
            break
        marks = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component), a table, after ``links`` (a, b) too; only the components that links join are worked out."""
    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    met = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    pairs = materialize(met.where("a <> b").distinct())
    if pairs.isEmpty():
        return found
    moved = materialize(connected_components(pairs))
    new = moved.join(found.select("node"), "node", "left_anti")
    kept = found.join(moved.select(F.col("node").alias("component"), F.col("component").alias("onto")), "component", "left").select("node", F.coalesce("onto", "component").alias("component"))
    return materialize(kept.union(new))
