"""Tool-call linking: calls meet their results, are ordered, checked against schemas and written as canonical JSON.

*Linking.*  Calls and results are hash-joined by (conversation, call id).  An id used twice
keeps its first call and first result (least turn, then least text); the others are counted.

*Order.*  A call names the calls it depends on, before or after it; its round is the length of the
longest chain of calls below it, 0 without dependencies, in every conversation alike.  Rounds come
from repeated steps over all calls at once: calls whose dependencies are all known are settled, and
a dependency on a call that waits for one other call only is moved on to that other call, with the
distance added.  So a chain of n calls takes about log2(n) steps, and no step makes the number of
dependencies grow.  When nothing more can be settled, what is left lies on a cycle or behind one.
Ordering by (round, turn, call_id) is a topological order.  Dependencies on unknown ids, and on the
call itself, are ignored; the latter are reported.

*Validation.*  Arguments are parsed natively to a variant and checked against the tool's
schema: required fields, no unknown fields, types, least and greatest values and lengths,
allowed values.  *Canonical JSON* has sorted keys, no white space and plain numbers.

A status is the first that applies: ``orphan_result``, ``unknown_tool``, ``bad_json``,
``invalid_arguments``, ``cyclic``, ``no_result``, ``result_first`` (its turn is not after the
call's), ``ok``.  Rows without conversation or id cannot link: calls get ``no_result`` at
best, results ``orphan_result``.  Null arguments are ``bad_json``.  Empty tables: every
result an orphan, every call without one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import materialize

#: A schema: field -> dict(type, required, min, max, min_length, max_length, values).
Schemas = dict[str, dict[str, dict]]
TYPE_PATTERNS = {
    "string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$", "null": "^VOID$"}


def _field_errors(parsed: Column, name: str, rule: dict) -> Column:
    """The first rule that a field breaks, as text, or null."""
    path = "$['" + name.replace("'", "\\'") + "']"
    value = F.try_variant_get(parsed, path, "variant")
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(parsed, path, "string"), F.try_variant_get(parsed, path, "double")
    error = F.when(value.isNull(), F.lit(f"{name}: missing") if rule.get("required") else F.lit(None).cast("string"))
    if "type" in rule:
        error = error.when(~kind.rlike(TYPE_PATTERNS[rule["type"]]), f"{name}: not {rule['type']}")
    for key, breaks in (
            ("min", lambda v: number < v), ("max", lambda v: number > v),
            ("min_length", lambda v: F.char_length(text) < v), ("max_length", lambda v: F.char_length(text) > v),
            ("values", lambda v: ~text.isin(*v))):
        if key in rule:
            error = error.when(breaks(rule[key]), f"{name}: {key}")
    return error


def argument_errors(tool: Column, arguments: Column, parsed: Column, schemas: Schemas) -> Column:
    """All rules broken, by tool; an empty array for tools without a schema."""
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.lit(None).cast("array<string>")
    for name, fields in schemas.items():
        known = F.array(*(F.lit(f) for f in fields)).cast("array<string>")
        unknown = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(": unknown")))
        each = F.array(*(_field_errors(parsed, f, rule) for f, rule in fields.items())).cast("array<string>")
        found = F.when(tool == name, F.concat(F.filter(each, lambda e: e.isNotNull()), unknown)).otherwise(found)
    return F.coalesce(found, F.array().cast("array<string>"))


NEEDS = "array<struct<target: string, distance: bigint>>"
FARTHEST = 1 << 40  # distances on cycles would double without end


def one_step(nodes: DataFrame) -> DataFrame:
    """All nodes, after dependencies on settled ones were settled and others moved on to what these wait for."""
    edges = nodes.select("conversation", "call_id", "base", F.explode("needs").alias("need"))
    below = nodes.select("conversation", F.col("call_id").alias("target"), F.col("base").alias("below"),
                         F.col("needs").alias("next"))
    joined = edges.select("*", F.col("need.target").alias("target"), F.col("need.distance").alias("distance")).join(
        below, ["conversation", "target"])
    waits, only = F.size("next"), F.element_at("next", 1)
    moved = joined.select(
        "conversation", "call_id", "base",
        F.when(waits <= 1, F.col("below") + F.col("distance")).alias("floor"),
        F.when(waits == 1, only["target"]).when(waits > 1, F.col("target")).alias("target"),
        F.when(waits == 1, F.least(only["distance"] + F.col("distance"), F.lit(FARTHEST)))
        .otherwise(F.col("distance")).alias("distance"))
    farthest = moved.groupBy("conversation", "call_id", "target").agg(
        F.max("base").alias("base"), F.max("floor").alias("floor"), F.max("distance").alias("distance"))
    stepped = farthest.groupBy("conversation", "call_id").agg(
        F.greatest(F.max("base"), F.max("floor")).alias("base"),
        F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "distance"))).alias("needs"))
    return nodes.where(F.size("needs") == 0).unionAll(stepped)


def rounds(calls: DataFrame) -> DataFrame:
    """conversation, call_id, round, cyclic (then round is null) of calls (conversation, call_id, needs), ids distinct.

    Every step writes one table of all nodes: ids, distance so far and what is left to wait for.
    """
    known = calls.select("conversation", F.col("call_id").alias("target"))
    edges = calls.select("conversation", "call_id", F.explode(F.array_distinct("needs")).alias("target")).where(
        "target <> call_id").join(known, ["conversation", "target"])
    needs = edges.groupBy("conversation", "call_id").agg(F.collect_list(F.struct(
        "target", F.lit(1).cast("bigint").alias("distance"))).alias("needs"))
    nodes = calls.where("conversation IS NOT NULL AND call_id IS NOT NULL").select("conversation", "call_id").join(
        needs, ["conversation", "call_id"], "left").select(
        "conversation", "call_id", F.lit(0).cast("bigint").alias("base"), F.coalesce("needs", F.array().cast(NEEDS)).alias("needs"))
    before = 0
    while True:
        nodes = materialize(nodes, "call-order")
        settled, waiting = nodes.agg(F.count_if(F.size("needs") == 0), F.count_if(F.size("needs") > 0)).first()
        if settled == before or not waiting:
            break
        nodes, before = one_step(nodes), settled
    cyclic = F.size("needs") > 0
    return nodes.select("conversation", "call_id", F.when(~cyclic, F.col("base").cast("int")).alias("round"), cyclic.alias("cyclic"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Link *calls* (conversation, call_id, turn, tool, arguments, needs) and *results* (conversation, call_id, turn, content).

    Returns conversation, call_id, turn, result_turn, tool, round, status, errors,
    n_calls and n_results with that id, json (canonical; null without a call or with bad JSON).
    """
    first_call = F.min(F.struct("turn", F.coalesce("tool", F.lit("")).alias("tool"), "arguments", "needs"))
    ones = calls.groupBy(F.col("conversation").cast("string").alias("conversation"), F.col("call_id").cast("string").alias(
        "call_id")).agg(first_call.alias("call"), F.count("*").alias("n_calls")).select(
        "conversation", "call_id", "call.*", "n_calls")
    ones = materialize(ones, "calls")
    others = results.groupBy(F.col("conversation").cast("string").alias("conversation"), F.col("call_id").cast(
        "string").alias("call_id")).agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results"))
    linked = ones.join(others, ["conversation", "call_id"], "full").join(
        rounds(ones), ["conversation", "call_id"], "left")
    parsed = linked.withColumn("parsed", F.try_parse_json("arguments"))
    checked = parsed.withColumn("errors", argument_errors(F.col("tool"), F.col("arguments"), F.col("parsed"), schemas))
    unknown = F.transform(F.array_sort(F.array_distinct(F.coalesce(F.filter(
        "needs", lambda n: n == F.col("call_id")), F.array().cast("array<string>")))), lambda n: F.concat(F.lit("needs itself: "), n))
    status = (F.when(F.col("n_calls").isNull(), "orphan_result")
              .when(~F.col("tool").isin(*schemas), "unknown_tool")
              .when(F.col("parsed").isNull() | ~F.schema_of_variant("parsed").startswith("OBJECT"), "bad_json")
              .when(F.size("errors") > 0, "invalid_arguments")
              .when(F.coalesce("cyclic", F.lit(False)), "cyclic")
              .when(F.col("n_results").isNull(), "no_result")
              .when(F.coalesce(F.col("result.turn") <= F.col("turn"), F.lit(False)), "result_first")
              .otherwise("ok"))
    record = F.to_json(F.struct(
        F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("result.content").alias("result"),
        F.col("tool").alias("tool")))
    return checked.select(
        "conversation", "call_id", "turn", F.col("result.turn").alias("result_turn"), "tool",
        F.when(F.col("n_calls").isNotNull() & ~F.coalesce("cyclic", F.lit(False)), F.coalesce("round", F.lit(0))).alias("round"),
        status.alias("status"), F.array_join(F.concat("errors", unknown), "; ").alias("errors"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(F.col("n_calls").isNotNull() & F.col("parsed").isNotNull(), record).alias("json"))


def calls_in(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as the turns of plain conversations give them.

    A turn of anyone but the assistant calls: ``configure`` for system turns, ``answer`` for
    the user's, else a tool of the role's name; its arguments are its text, its length and its turn,
    or null for a null text.  An assistant turn is the result of the call in the turn before it,
    the first turn that of the call after it.  The parity of a call's length stands for the direction
    of its dependencies: even lengths need the call two turns before, odd ones that two turns after;
    lengths divisible by three also the call four turns away, in the same direction.
    """
    def name(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), turn.cast("string"))

    rows = conversations.select(F.col("conv_id").cast("string").alias("conversation"), "turn", "role", "text")
    length = F.char_length(F.coalesce("text", F.lit("")))
    arguments = F.when(F.col("text").isNotNull(), F.to_json(F.struct("text", length.alias("length"), F.col("turn").alias("turn"))))
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    way = F.when(length % 2 == 0, -2).otherwise(2)
    needs = F.when(length % 3 == 0, F.array(name(F.col("turn") + way), name(F.col("turn") + 2 * way))).otherwise(
        F.array(name(F.col("turn") + way)))
    calls = rows.where(~assistant).select(
        "conversation", name(F.col("turn")).alias("call_id"), "turn",
        F.when(F.col("role") == "system", "configure").when(F.col("role") == "user", "answer").otherwise(
            F.coalesce("role", F.lit(""))).alias("tool"),
        arguments.alias("arguments"), F.when(F.col("turn").isNotNull(), needs).alias("needs"))
    results = rows.where(assistant).select(
        "conversation", name(F.when(F.col("turn") == 0, 1).otherwise(F.col("turn") - 1)).alias("call_id"), "turn",
        F.col("text").alias("content"))
    return calls, results
