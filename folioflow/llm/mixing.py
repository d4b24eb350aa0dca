"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the weights, and each document is
emitted floor(rate) times plus one more copy with probability equal to the fraction,
drawn from a hash of the seed and the document's id. Only DataFrame functions are used.

Defined cases
* null text: size 0; such a document never adds words but is emitted like any other.
* null source: a source of its own, last in order.
* null doc_id: the draw hashes the marker ``null``.
* repeated rows: each row counts; rows with one doc_id share one draw.
* empty table: empty result. A source of size 0 has target 0 and rate 0.
* extra columns travel along; plan columns (``size``, ``source_size``, ``target``,
  ``rate``, ``copies``, ``taken``) replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.broadcasts import small_side
from folioflow.llm.names import free_names
from folioflow.store import materialize

WORD = r"[^\x20\x09-\x0D]+"
PLAN_COLUMNS = ("size", "source_size", "target", "rate", "copies", "taken")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and divide
    ``share`` times the total size. A target is at most ``cap`` times its source's
    size; what is cut off goes to the others by weight until none is above. One row
    per source reaches the ordering windows, never one per document.

    The level that reshares to rest is found directly: in ascending order of
    cap/weight the capped sources form a prefix, and source k is capped exactly if its
    cap/weight is at most the budget left per unit of weight before it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("double").alias("total"))
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    capped = ranked.select("source", "total", "place", weight.alias("weight"), (F.lit(float(cap)) * F.col("total")).alias("most"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    everyone = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = capped.select(
        "*",
        (F.lit(float(share)) * F.sum("total").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(onward).alias("open_weight"),
    )
    # the level only counts where the source stays below its cap; beyond the last capped one it is constant
    fits = F.col("most") / F.col("weight") > F.col("left") / F.col("open_weight")
    level = F.min_by(F.when(fits, F.col("left") / F.col("open_weight")), F.when(fits, F.struct(F.col("most") / F.col("weight"), "place"))).over(everyone)
    return levels.select(
        "source",
        F.col("total").cast("long").alias("source_size"),
        F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"),
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    max_broadcast_sources: int = 200_000,
) -> DataFrame:
    """Every input row with its size, its source's figures, its copies and its taken words.

    The table of sources is broadcast if it has at most ``max_broadcast_sources`` rows
    (about 20 MB); otherwise the join shuffles, and adaptive execution splits a hot
    source's rows.
    """
    kept = [c for c in docs.columns if c not in PLAN_COLUMNS]
    sized = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    plan = materialize(source_targets(sized.select("source", "size"), weights, share, cap))
    (own,) = free_names(sized, "plan_source")
    side = small_side(plan.withColumnRenamed("source", own), max_broadcast_sources)
    joined = sized.join(side, F.col("source").eqNullSafe(F.col(own)), "left").drop(own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + F.when(uniform("doc_id", seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def uniform(column: str, seed: str):
    """Draw in [0, 1) from the first 13 hex digits of md5(seed:value)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each input row as often as the plan takes it, same columns."""
    plan = mix_plan(docs, **options).where("copies > 0")
    (copy,) = free_names(docs, "copy")
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(copy)
    return plan.select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop(copy)
