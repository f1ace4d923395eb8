"""Chat formatting: tool-call linking.

Calls and results meet by an equi-join on conversation and identifier; calls
are put in topological order of their dependencies, their arguments are
validated against schemas, and each linked call is serialised as canonical
JSON (sorted keys, no blanks).

Order: a call's rank is its turn, or one more than the largest rank of what it
depends on if that is more. Calls nearly always depend on earlier turns, and
then ranks are turns. In conversations where a call refers to one that is not
earlier, calls whose dependencies are all placed are placed, round by round, and
a call with one dependency left that itself has one left takes that one's
instead: so chains are halved, and rounds grow with the logarithm of their
length. When a round places nothing, the calls left are exactly those of
dependency cycles and those that depend on them. Positions come from ranks by
range first and within the range then, so that a conversation with a third of
all calls is not one group.

Defined cases: a result counts once a call, the earliest turn first; further
results are only counted (``n_results``); a call without result has null for it;
a result without call is left out; a dependency that no call of the
conversation has is an error of the call and orders nothing; calls of a
dependency cycle, and those that depend on one, come last in their conversation
with ``ordered`` false, by turn; calls that share
an identifier are linked to the same result each; arguments that are no JSON
object are an error; null identifiers link to nothing; conversations may be
null; empty tables give an empty result; other columns are unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scratch, table

#: Ranks of one conversation that are numbered together.
RANGE = 1024

#: Tool -> parameter -> what its value must be.
SCHEMAS = {
    "search": {"query": {"type": "string", "required": True, "min_length": 1, "max_length": 300}, "turn": {"type": "integer", "required": True, "minimum": 0}},
    "setup": {"instructions": {"type": "string", "required": True, "max_length": 200}, "turn": {"type": "integer", "required": True}},
}
VARIANT = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def validate(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Errors of a call's JSON arguments, in order of the parameters' names."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    errors = [F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.lit("unknown tool")), F.when(~is_object, F.lit("arguments are no object"))]
    for tool, parameters in sorted(schemas.items()):
        here = name.eqNullSafe(tool) & is_object
        keys = F.json_object_keys(arguments)
        extra = F.array_sort(F.array_except(keys, F.array(*map(F.lit, sorted(parameters)))))
        errors.append(F.when(here & (F.size(extra) > 0), F.concat(F.lit("unknown: "), F.array_join(extra, ","))))
        for key, rule in sorted(parameters.items()):
            value = F.try_variant_get(parsed, f"$.{key}", "variant")
            there = value.isNotNull() & ~F.is_variant_null(value)
            if rule.get("required"):
                errors.append(F.when(here & ~F.coalesce(there, F.lit(False)), F.lit(f"{key}: missing")))
            right = F.schema_of_variant(value) == VARIANT[rule["type"]]
            errors.append(F.when(here & there & ~right, F.lit(f"{key}: not {rule['type']}")))
            text, number = F.try_variant_get(parsed, f"$.{key}", "string"), F.try_variant_get(parsed, f"$.{key}", "bigint")
            for limit, wrong in (("min_length", lambda n, t=text: F.length(t) < n), ("max_length", lambda n, t=text: F.length(t) > n), ("minimum", lambda n, v=number: v < n)):
                if limit in rule:
                    errors.append(F.when(here & there & right & wrong(rule[limit]), F.lit(f"{key}: {limit} {rule[limit]}")))
    return F.array_compact(F.array(*errors))


def same_call(conv: str, call: str) -> Column:
    """Join condition on conversation and identifier. It is written alike everywhere, so that joins share a partitioning."""
    return F.col("conv_id").eqNullSafe(F.col(conv)) & F.col("call_id").eqNullSafe(F.col(call))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls with ``result`` and ``n_results``; hash join on conversation and identifier."""
    met = results.filter("call_id IS NOT NULL").groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
    met = met.agg(F.min_by("content", F.struct("turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results"))
    return calls.join(met.hint("shuffle_hash"), same_call("_conv", "_call"), "left").drop("_conv", "_call").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))


def ranks(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """_conv, _call, rank, ordered for each identifier; ranks respect the dependencies.

    calls: conv_id, call_id, turn, depends_on (array of identifiers).
    """
    least = calls.filter("call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    least = least.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.coalesce("turn", F.lit(0)).cast("long").alias("rank"))
    edges = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("child"), F.explode("depends_on").alias("parent")).filter("child IS NOT NULL AND parent IS NOT NULL").distinct()

    def met(now: DataFrame) -> DataFrame:
        """The edges between identifiers that are there, with both ends' rank and, if there, id."""
        p = now.select(*(F.col(c).alias(f"_p{c}") for c in now.columns))
        k = now.select(*(F.col(c).alias(f"_k{c}") for c in now.columns))
        return edges.join(p, F.col("_c").eqNullSafe(F.col("_p_conv")) & (F.col("parent") == F.col("_p_call"))).join(k, F.col("_c").eqNullSafe(F.col("_k_conv")) & (F.col("child") == F.col("_k_call")))

    forward = cut(spark, met(least).filter("_krank <= _prank").select("_c").distinct(), "forward")
    if forward.isEmpty():
        return least.withColumn("ordered", F.lit(True))
    here = F.col("_conv").eqNullSafe(F.col("_c"))
    nodes = cut(spark, least.join(forward, here, "left_semi").withColumn("id", F.monotonically_increasing_id()), "nodes")
    links = cut(spark, met(nodes).select(F.col("_kid").alias("v"), F.col("_pid").alias("u"), F.lit(1).cast("long").alias("w")), "links")
    done = placed_ranks(spark, nodes.select("id", "rank"), links).withColumnRenamed("rank", "_placed")
    found = nodes.join(done, "id", "left").select("_conv", "_call", F.coalesce("_placed", "rank").alias("rank"), F.col("_placed").isNotNull().alias("ordered"))
    return least.join(forward, here, "left_anti").withColumn("ordered", F.lit(True)).unionByName(found)


def placed_ranks(spark: SparkSession, state: DataFrame, links: DataFrame) -> DataFrame:
    """id, rank of what is in no cycle of ``links`` and behind none.

    state: id, rank (at least). links: v, u, w; the rank of v is at least that of u plus w.
    """
    folder, k = scratch(spark, "placed"), 0
    while True:
        free = f"{folder}/round={k}"
        state.join(links, F.col("id") == F.col("v"), "left_anti").write.parquet(free)
        free = spark.read.schema("id long, rank long").parquet(free)
        if free.isEmpty():
            return spark.read.schema("id long, rank long").parquet(folder)
        first = links.join(free.select(F.col("id").alias("u"), "rank"), "u").groupBy(F.col("v").alias("id")).agg(F.max(F.col("rank") + F.col("w")).alias("_need"))
        state = cut(spark, state.join(free, "id", "left_anti").join(first, "id", "left").select("id", F.greatest("rank", "_need").alias("rank")), "state")
        links = cut(spark, links.join(free, F.col("u") == F.col("id"), "left_anti"), "links")
        # Calls with one link whose other end has one link too: the rank there is known but for that link.
        one = links.groupBy("v").agg(F.count(F.lit(1)).alias("_n"), F.first("u").alias("u"), F.first("w").alias("w")).filter("_n = 1").drop("_n")
        via = one.join(state, F.col("v") == F.col("id")).select(F.col("v").alias("_v"), F.col("u").alias("_u"), F.col("w").alias("_w"), "rank")
        jump = cut(spark, one.join(via, F.col("u") == F.col("_v")).select(F.col("v").alias("_jv"), "_u", (F.col("w") + F.col("_w")).alias("_sum"), (F.col("rank") + F.col("w")).alias("_need")), "jump")
        state = cut(spark, state.join(jump, F.col("id") == F.col("_jv"), "left").select("id", F.greatest("rank", "_need").alias("rank")), "state")
        links = cut(spark, links.join(jump, F.col("v") == F.col("_jv"), "left").select("v", F.coalesce("_u", "u").alias("u"), F.coalesce("_sum", "w").alias("w")), "links")
        k += 1


def positions(ranked: DataFrame) -> DataFrame:
    """``position`` of each call in its conversation, from 0, by rank, turn and identifier; the unordered last."""
    bucket = F.struct(~F.col("ordered"), F.floor(F.col("rank") / RANGE))
    rows = ranked.withColumn("_bucket", bucket)
    sums = rows.groupBy("conv_id", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("_bucket").alias("_b"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_bucket").orderBy("rank", "turn", "call_id")) - 1
    out = rows.withColumn("_inside", inside).join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn("position", F.col("_before") + F.col("_inside")).drop("_inside", "_before", "_c", "_b", "_bucket")


def canonical_json(call_id: Column, name: Column, arguments: Column, result: Column, errors: Column) -> Column:
    """One linked call; a variant object keeps its keys sorted, and the fields here are sorted too."""
    parsed = F.try_parse_json(arguments)
    fields = (("arguments", parsed), ("call_id", call_id), ("errors", errors), ("name", name), ("result", result))
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields)), {"ignoreNullFields": "false"})


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, call_id, position, ordered, n_results, errors, json of every call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on.
    results: conv_id, call_id, turn, content.
    """
    spark = calls.sparkSession
    # Order and dependencies go by identifiers alone; the texts are dealt once, for the link.
    known = cut(spark, calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on"), "calls").withColumn("_row", F.monotonically_increasing_id())
    places = placed(spark, known.select("conv_id", "call_id", "turn", "depends_on", "_row"))
    places = places.select(F.col("conv_id").alias("_pc"), F.col("call_id").alias("_pk"), F.col("_row").alias("_place"), "position", "ordered", "_absent")
    rows = link(known, results).join(places, same_call("_pc", "_pk") & (F.col("_row") - F.col("_place") == 0))
    lacking = F.when(F.col("_absent").isNotNull(), F.array(F.concat(F.lit("unknown dependency: "), F.array_join("_absent", ",")))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("errors", F.concat(validate(F.col("name"), F.col("arguments"), schemas), lacking))
    text = canonical_json(F.col("call_id"), F.col("name"), F.col("arguments"), F.col("result"), F.col("errors"))
    return rows.select("conv_id", "call_id", F.col("position").cast("long").alias("position"), "ordered", "n_results", "errors", text.alias("json"))


def placed(spark: SparkSession, calls: DataFrame) -> DataFrame:
    """calls with ``position``, ``ordered`` and ``_absent``: the dependencies that no call of the conversation has."""
    order = ranks(spark, calls)
    ranked = calls.join(order, same_call("_conv", "_call"), "left").drop("_conv", "_call").withColumn("ordered", F.coalesce("ordered", F.lit(False))).withColumn("rank", F.coalesce("rank", "turn", F.lit(0)))
    asked = calls.select(F.col("conv_id").alias("_mc"), F.col("call_id").alias("_mk"), F.explode("depends_on").alias("_dep")).distinct()
    there = calls.select(F.col("conv_id").alias("_tc"), F.col("call_id").alias("_tk")).distinct()
    absent = asked.join(there, F.col("_mc").eqNullSafe(F.col("_tc")) & (F.col("_dep") == F.col("_tk")), "left_anti").groupBy("_mc", "_mk").agg(F.array_sort(F.collect_set("_dep")).alias("_absent"))
    return positions(ranked.join(absent, same_call("_mc", "_mk"), "left").drop("_mc", "_mk"))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results read out of plain conversations.

    A user's turn is a call of ``search``, a system turn one of ``setup``; the
    assistant's turn is the result of the turn before it. A call depends on the
    one two turns earlier.
    """
    identifier = lambda turn: F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), turn.cast("string"))
    asks = conversations.filter("role IN ('user', 'system')")
    by_role = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("turn"), F.col("text").alias("query")))).otherwise(F.to_json(F.struct(F.col("turn"), F.col("text").alias("instructions"))))
    earlier = F.when(F.col("turn") >= 2, F.array(identifier(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = asks.select("conv_id", identifier(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "user", "search").otherwise("setup").alias("name"), by_role.alias("arguments"), earlier.alias("depends_on"))
    results = conversations.filter("role = 'assistant'").select("conv_id", identifier(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op2_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    return format_calls(calls, results).withColumn("errors", F.array_join("errors", "; "))


SQL = r"""
WITH calls AS (
  SELECT conv_id, conv_id || '-' || turn AS call_id, turn, role, text, CASE WHEN turn >= 2 THEN conv_id || '-' || (turn - 2) END AS dep
  FROM conversations WHERE role IN ('user', 'system')),
results AS (
  SELECT conv_id || '-' || (turn - 1) AS call_id, arg_min(text, turn) AS result, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
judged AS (
  SELECT c.*, r.result, coalesce(r.n, 0) AS n_results,
    [x FOR x IN [
      CASE WHEN role = 'user' AND length(text) > 300 THEN 'query: max_length 300' END,
      CASE WHEN role = 'system' AND length(text) > 200 THEN 'instructions: max_length 200' END,
      CASE WHEN dep IS NOT NULL AND dep NOT IN (SELECT call_id FROM calls) THEN 'unknown dependency: ' || dep END] IF x IS NOT NULL] AS errors
  FROM calls c LEFT JOIN results r USING (call_id))
SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, true AS ordered, n_results,
  array_to_string(errors, '; ') AS errors,
  '{"arguments":' || CASE role WHEN 'user' THEN '{"query":' || to_json(text) || ',"turn":' || turn || '}' ELSE '{"instructions":' || to_json(text) || ',"turn":' || turn || '}' END
  || ',"call_id":"' || call_id || '","errors":' || to_json(errors) || ',"name":"' || CASE role WHEN 'user' THEN 'search' ELSE 'setup' END || '","result":' || coalesce(to_json(result)::VARCHAR, 'null') || '}' AS json
FROM judged
"""
