"""Tool-call linking for chat formatting, with DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier), ordered topologically
by what a call says it comes after, checked against argument schemas, and serialised as
canonical JSON: keys in order, no blanks, one line per linked call. One row per call
leaves the operator; a conversation is never gathered into a row.

Order: ``level`` is 0 for a call that waits for none, else one more than the highest
level it waits for. If no call waits for more than one, pointers that double their reach give
levels in log(depth) rounds; otherwise each round settles the calls whose dependencies
are settled, so the number of rounds is the depth of the dependencies.

Defined cases
* an identifier used by several calls: the first (smallest turn) is the call, ``n_calls``
  counts all. Several results: the first one is linked, ``n_results`` counts all.
* call without result: status ``unanswered``. Result without call: status ``orphan``. Result in an earlier turn
  than its call: status ``early``.
* dependencies on identifiers that the conversation lacks are dropped and reported; calls on
  a cycle, or behind one, have level null and the error ``cycle``.
* null or broken argument JSON, or JSON other than an object: error ``arguments``. Unknown tool: error ``tool``.
* rows with a null conversation or identifier take no part. Empty tables: empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.broadcasts import small_side
from folioflow.store import materialize

KEY = ["conv_id", "call_id"]


def first_calls(calls: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id): its first call and how many there are."""
    usable = calls.dropna(subset=KEY)
    one = usable.groupBy(*KEY).agg(F.min(F.struct("turn", "tool", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    return one.select(*KEY, F.col("c.turn").alias("call_turn"), "c.tool", "c.arguments", F.array_distinct(F.coalesce("c.after", F.array().cast("array<string>"))).alias("after"), "n_calls")


def first_results(results: DataFrame) -> DataFrame:
    one = results.dropna(subset=KEY).groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    return one.select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, missing): level null on or behind a cycle; missing lists unknown dependencies."""
    waits = calls.select(*KEY, F.explode("after").alias("dep"))
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("known"))
    edges = materialize(waits.join(known, ["conv_id", "dep"], "left"))
    missing = edges.where("known is null").groupBy(*KEY).agg(F.sort_array(F.collect_set("dep")).alias("missing"))
    open_edges = edges.where("known").drop("known")
    needs = open_edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("needed"))
    most = needs.agg(F.max("needed")).first()[0] or 0
    if most <= 1:
        return calls.select(*KEY).join(_forest_levels(calls, open_edges), KEY, "left").join(missing, KEY, "left")
    waiting = materialize(needs.withColumn("met", F.lit(0).cast("long")).withColumn("highest", F.lit(-1)))
    newest = materialize(calls.select(*KEY).join(waiting, KEY, "left_anti").withColumn("level", F.lit(0)))
    settled = [newest]
    # every round reads only what the last one settled, so plans stay of one size
    while newest.limit(1).count():
        hits = open_edges.join(newest.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("more"), F.max("level").alias("top"))
        counted = waiting.join(hits, KEY, "left").select(*KEY, "needed", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"), F.greatest("highest", "top").alias("highest"))
        counted = materialize(counted)
        newest = materialize(counted.where("met = needed").select(*KEY, (F.col("highest") + 1).cast("int").alias("level")))
        waiting = counted.where("met < needed")
        settled.append(newest)
    return calls.select(*KEY).join(reduce(DataFrame.unionByName, settled), KEY, "left").join(missing, KEY, "left")


def _forest_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) where each call waits for at most one: pointers double their reach, so rounds are the logarithm of the depth."""
    now = materialize(calls.select(*KEY).join(edges, KEY, "left").select(*KEY, F.col("dep").alias("up"), F.when(F.col("dep").isNotNull(), 1).otherwise(0).alias("level")))
    left = now.where("up is not null").count()
    while left:
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        now = materialize(now.join(above, ["conv_id", "up"], "left").select(*KEY, F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).cast("int").alias("level")))
        still = now.where("up is not null").count()
        if still == left:  # every finite chain would have shortened: what is left runs in circles
            break
        left = still
    return now.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def argument_errors(calls: DataFrame, schemas: DataFrame, max_tools: int = 100_000) -> DataFrame:
    """``calls`` with canonical arguments and errors, from schemas (tool, name, kind, required).

    Kinds are JSON kinds: string, integer, number, boolean, array, object. A tool's schema is
    one row; the tools are broadcast if there are at most ``max_tools``.
    """
    tools = schemas.dropna(subset=["tool", "name", "kind"]).groupBy("tool").agg(F.sort_array(F.collect_set(F.struct("name", "kind", F.coalesce("required", F.lit(False)).alias("required")))).alias("wanted"))
    joined = calls.join(small_side(tools, max_tools), "tool", "left")
    parsed = joined.withColumn("__v", F.try_parse_json("arguments")).withColumn("__o", F.expr("startswith(schema_of_variant(__v), 'OBJECT')"))
    given = parsed.withColumn("__m", F.when(F.col("__o"), F.from_json("arguments", "map<string,variant>"))).withColumn("__raw", F.to_json("__v"))

    def found(name):
        return F.array_contains(F.map_keys("__m"), name)

    def kind_of(name):
        shape = F.schema_of_variant(F.element_at("__m", name))
        return (
            F.when(shape == "STRING", "string").when(shape == "BIGINT", "integer").when(shape.startswith("DECIMAL") | (shape == "DOUBLE"), "number")
            .when(shape == "BOOLEAN", "boolean").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("null")
        )

    def problem(s):
        kind = kind_of(s["name"])
        right = (kind == s["kind"]) | ((s["kind"] == "number") & (kind == "integer"))
        return F.when(~found(s["name"]), F.when(s["required"], F.concat(F.lit("missing:"), s["name"]))).when(~right, F.concat(F.lit("kind:"), s["name"]))

    by_schema = F.filter(F.transform("wanted", problem), lambda e: e.isNotNull())
    unknown = F.transform(F.array_except(F.map_keys("__m"), F.transform("wanted", lambda s: s["name"])), lambda n: F.concat(F.lit("unknown:"), n))
    errors = (
        F.when(F.col("wanted").isNull(), F.array(F.lit("tool")))
        .when(~F.coalesce("__o", F.lit(False)), F.array(F.lit("arguments")))
        .otherwise(F.array_sort(F.concat(by_schema, unknown)))
    )
    return given.withColumn("errors", errors).withColumn("canonical", F.when(F.col("__o"), F.col("__raw"))).drop("wanted", "__v", "__o", "__m", "__raw")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call: turns, level, errors, status and canonical JSON."""
    own = materialize(first_calls(calls))
    ordered = materialize(levels(own))
    checked = materialize(argument_errors(own, schemas)).join(ordered, KEY)
    joined = checked.join(first_results(results), KEY, "full")
    cycle = F.col("level").isNull() & F.col("call_turn").isNotNull()
    errors = F.concat(
        F.coalesce("errors", F.array().cast("array<string>")),
        F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda d: F.concat(F.lit("after:"), d)),
        F.when(cycle, F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
    )
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").when(F.col("result_turn") < F.col("call_turn"), "early").otherwise("linked")
    quoted = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    # keys stand in order: arguments, id, result, tool
    text = F.concat(
        F.lit("{"),
        F.when(F.col("canonical").isNotNull(), F.concat(F.lit('"arguments":'), F.col("canonical"), F.lit(","))).otherwise(""),
        F.lit('"id":'), quoted(F.col("call_id")),
        F.when(F.col("content").isNotNull(), F.concat(F.lit(',"result":'), quoted(F.col("content")))).otherwise(""),
        F.when(F.col("tool").isNotNull(), F.concat(F.lit(',"tool":'), quoted(F.col("tool")))).otherwise(""),
        F.lit("}"),
    )
    return joined.select(
        *KEY, "tool", "call_turn", "result_turn", "level",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        errors.alias("errors"), (F.size(errors) == 0).alias("valid"), status.alias("status"), text.alias("message"),
    )
