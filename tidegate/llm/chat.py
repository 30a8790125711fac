"""Chat formatting: tool calls linked to their results, ordered by what they need, checked and written as canonical JSON.

Messages stay rows. Calls and results meet in a hash join on conversation and
call id, so a conversation of any length is spread by its calls. The order is a
level per call, one more than the highest level it needs; every round of it is a
join over the edges that are left, so the number of rounds is the longest chain
of needs, and calls in a cycle are found as those that never get a level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stable


@dataclass(frozen=True)
class Field:
    name: str
    kind: str                   # string, integer, number, boolean, array or object
    required: bool = True


@dataclass(frozen=True)
class Tool:
    """Schema of a tool's arguments; fields that it does not name are errors."""

    name: str
    fields: tuple[Field, ...]


# Type names that a parsed JSON value reports, by the schema's kind.
_KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*", "object": "^OBJECT<.*",
}


def argument_errors(tools: list[Tool], name: Column, arguments: Column) -> Column:
    """Sorted errors of a call's arguments (JSON text); empty for valid ones. ``tools`` is a short list.

    NULL or broken JSON, or JSON other than an object, is the one error ``no object``.
    """
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    errors = None
    for tool in tools:
        checks = []
        for f in tool.fields:
            kind = F.schema_of_variant(F.try_variant_get(parsed, f"$['{f.name}']", "variant"))
            missing = ~F.array_contains(keys, f.name)
            if f.required:
                checks.append(F.when(missing, F.lit(f"missing {f.name}")))
            checks.append(F.when(~missing & ~F.coalesce(kind.rlike(_KINDS[f.kind]), F.lit(False)), F.lit(f"type {f.name}")))
        known = F.array(*(F.lit(f.name) for f in tool.fields)) if tool.fields else F.array().cast("array<string>")
        unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown "), k))
        found = F.array_sort(F.concat(F.array_compact(F.array(*checks)), unknown))
        errors = F.when(name == tool.name, found) if errors is None else errors.when(name == tool.name, found)
    no_tool = F.array(F.lit("unknown tool"))
    errors = no_tool if errors is None else errors.otherwise(no_tool)
    is_object = F.coalesce(F.schema_of_variant(parsed).rlike("^OBJECT"), F.lit(False))
    return F.when(is_object, errors).otherwise(F.array(F.lit("no object")))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of calls (conv_id, call_id, needs); NULL in a cycle or behind one.

    Needs that no call of the conversation answers do not count.
    """
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).join(
        nodes.withColumnRenamed("call_id", "need"), ["conv_id", "need"]).distinct()
    edges = stable(edges)
    done = stable(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    left = edges.count()
    while left:
        known = edges.join(done.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
        ready = known.groupBy("conv_id", "call_id").agg(
            (F.max("level") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        ready = stable(ready.select("conv_id", "call_id", "level"))
        edges = stable(edges.join(ready, ["conv_id", "call_id"], "left_anti"))
        rest = edges.count()
        if rest == left:
            break
        done, left = done.unionByName(ready), rest
    return nodes.join(done, ["conv_id", "call_id"], "left")


def format_chat(messages: DataFrame, tools: list[Tool]) -> DataFrame:
    """conv_id, turn, kind, call_id, status, level, errors, message: one row per row of ``messages``.

    ``messages`` has conv_id, turn, kind (message, call or result), role, text,
    call_id, name, arguments (JSON text) and needs (array of call ids); other
    columns are ignored. Status of a call: linked, pending (no result),
    duplicate (its id is called more than once); of a result: linked, orphan (no
    call), duplicate; of a plain message: plain. Rows whose conv_id or call_id is
    NULL meet no other. ``level`` orders the calls of a conversation after what
    they need, a result has its call's level, plain messages 0; NULL means a
    cycle. ``message`` is JSON with sorted keys and no blanks; absent values are
    left out, and arguments that do not parse are kept as text.
    """
    rows = messages.select("conv_id", "turn", "kind", "role", "text", "call_id", "name", "arguments",
                           F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    keys = ["conv_id", "call_id"]
    keyed = rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    calls = stable(keyed.where("kind = 'call'").groupBy(*keys).agg(
        F.count("*").alias("calls"), F.min("turn").alias("call_turn"),
        F.array_distinct(F.flatten(F.collect_set("needs"))).alias("needs")))
    results = keyed.where("kind = 'result'").groupBy(*keys).agg(
        F.count("*").alias("results"), F.min("turn").alias("result_turn"))
    linked = calls.drop("needs").join(results.hint("shuffle_hash"), keys, "full_outer").join(levels(calls), keys, "left")
    out = rows.join(linked, keys, "left")
    kind, calls_of, results_of = F.col("kind"), F.coalesce("calls", F.lit(0)), F.coalesce("results", F.lit(0))
    status = F.when(kind == "call", F.when(calls_of > 1, "duplicate").when(results_of > 0, "linked").otherwise("pending")
                    ).when(kind == "result", F.when(calls_of == 0, "orphan").when(results_of > 1, "duplicate")
                           .otherwise("linked")).otherwise("plain")
    is_call = kind == "call"
    errors = F.when(is_call, argument_errors(tools, F.col("name"), F.col("arguments"))).otherwise(
        F.array().cast("array<string>"))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("arguments").alias("a"))), "(?s)^.\"a\":(.*).$", 1)
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), quoted)
    body = F.to_json(F.struct(
        F.when(kind != "message", F.col("call_id")).alias("call_id"),
        F.when(is_call, F.col("name")).alias("name"),
        F.when(is_call & (F.size("needs") > 0), F.array_sort("needs")).alias("needs"),
        F.col("role").alias("role"),
        F.col("text").alias("text"),
    ))
    inner = F.substr(body, F.lit(2))
    message = F.when(is_call & F.col("arguments").isNotNull(), F.concat(
        F.lit('{"arguments":'), canonical, F.when(inner == "}", F.lit("")).otherwise(F.lit(",")), inner)).otherwise(body)
    level = F.when(kind == "message", F.lit(0)).when(calls_of == 0, F.lit(0)).otherwise(F.col("level"))
    return out.select("conv_id", "turn", "kind", "call_id", status.alias("status"), level.alias("level"),
                      F.array_join(errors, "; ").alias("errors"), message.alias("message"))
