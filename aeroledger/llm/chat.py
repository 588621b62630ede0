"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Everything is DataFrame code. Calls are reduced to the first one of each
identifier, so the hash join with the results has one row on its build side for
each key and a result never multiplies. The order is topological: a result
comes after its call even where it was logged before it, and everything else
keeps its turn. It is given as sort keys (``order_turn``, ``order_step``), so no
conversation is gathered in a task. Arguments are parsed into the variant type,
whose objects hold their keys sorted: its text is the canonical form.

Defined cases: a null conversation, turn or identifier links with nothing; a
repeated call is kept but only its first row is linked, every repeated result
is linked; a call without a known schema, with unparsable arguments, a missing
required argument, an unknown argument or one of another type is not valid;
arguments beyond the size limit of a variant count as unparsable; an empty
table gives an empty result; null fields are left out of the JSON.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

#: Argument types of a schema and the variant types that satisfy them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": "(BIGINT|DOUBLE|DECIMAL.*)"}

Schema = Mapping[str, tuple[str, bool]]


def arguments_valid(name: Column, arguments: Column, schemas: Mapping[str, Schema]) -> Column:
    """Whether a variant object has all required arguments of its tool, no others, and each of its type."""
    shape = F.schema_of_variant(arguments)
    keys = F.json_object_keys(F.to_json(arguments))
    checks = F.lit(False)
    for tool, schema in schemas.items():
        good = shape.startswith("OBJECT") & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in schema]))) == 0)
        for key, (kind, required) in schema.items():
            of_key = F.schema_of_variant(F.try_variant_get(arguments, f"$['{key}']", "variant"))
            here = of_key.rlike(f"^{_TYPES[kind]}$")
            good = good & (F.coalesce(here, F.lit(False)) if required else F.coalesce(here, F.lit(True)))
        checks = F.when(name == tool, good).otherwise(checks)
    return F.coalesce(checks, F.lit(False))


def link_calls(messages: DataFrame, schemas: Mapping[str, Schema]) -> DataFrame:
    """Rows of ``messages`` linked, ordered, validated and serialised.

    ``messages`` has (conv_id, turn, role, text, call_id, name, arguments, result_of): a row with a call_id is a
    call, one with a result_of is a result, any other is a message. Returns (conv_id, turn, kind, call_id, call_turn,
    order_turn, order_step, valid, json).
    """
    rows = messages.select("conv_id", "turn", "role", "text", "call_id", "name", "arguments", "result_of")
    first = (
        rows.where("call_id IS NOT NULL AND conv_id IS NOT NULL")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"))
        .agg(F.min("turn").alias("call_turn"))
    )
    linked = rows.join(
        first.hint("shuffle_hash"), (F.col("conv_id") == F.col("_conv")) & (F.col("result_of") == F.col("_call")), "left"
    )
    is_call, is_result = F.col("call_id").isNotNull(), F.col("_call").isNotNull()
    parsed = linked.withColumn("_arguments", F.when(is_call, F.try_parse_json("arguments")))
    valid = F.when(is_call, arguments_valid(F.col("name"), F.col("_arguments"), schemas))
    body = F.when(is_call, F.to_json(F.struct(
        F.col("_arguments").alias("arguments"), F.col("call_id").alias("id"), "name", "role", "turn", F.col("_valid").alias("valid"),
    ))).when(is_result, F.to_json(F.struct(
        F.col("text").alias("content"), F.col("result_of").alias("result_of"), "role", "turn",
    ))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), "role", "turn")))
    return parsed.withColumn("_valid", valid).select(
        "conv_id", "turn",
        F.when(is_call, "call").when(is_result, "result").otherwise("message").alias("kind"),
        F.coalesce("call_id", F.when(is_result, F.col("result_of"))).alias("call_id"),
        F.when(is_result, F.col("call_turn")).alias("call_turn"),
        F.greatest("turn", F.when(is_result, F.col("call_turn"))).alias("order_turn"),
        F.when(is_result, 1).otherwise(0).alias("order_step"),
        F.col("_valid").alias("valid"), body.alias("json"),
    )


def parse_messages(conversations: DataFrame) -> DataFrame:
    """Rows for ``link_calls`` from texts in the usual JSON form.

    A text ``{"tool_calls": [{"id", "name", "arguments"}]}`` gives one row for each call, a text
    ``{"tool_call_id", "content"}`` of role ``tool`` is a result, any other text is a message.
    """
    form = "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string, content string"
    read = conversations.select("conv_id", "turn", "role", "text", F.from_json(
        F.when(F.ltrim(F.col("text")).startswith("{"), F.col("text")), form).alias("_j"))
    none = F.array(F.lit(None).cast("struct<id:string,name:string,arguments:string>"))
    calls = F.when((F.col("role") == "assistant") & (F.size("_j.tool_calls") > 0), F.col("_j.tool_calls")).otherwise(none)
    is_result = F.coalesce((F.col("role") == "tool") & F.col("_j.tool_call_id").isNotNull(), F.lit(False))
    return read.withColumn("_call", F.explode(calls)).select(
        "conv_id", "turn", "role", F.when(is_result, F.coalesce("_j.content", F.lit(""))).otherwise(F.col("text")).alias("text"),
        F.col("_call.id").alias("call_id"), F.col("_call.name").alias("name"), F.col("_call.arguments").alias("arguments"),
        F.when(is_result, F.col("_j.tool_call_id")).alias("result_of"),
    )


def turns_as_calls(conversations: DataFrame, name: str = "respond") -> DataFrame:
    """Rows for ``link_calls`` from plain turns: a user turn calls ``name``, the assistant turn after it is the result."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when(user, F.concat(F.col("conv_id"), F.lit(":"), F.col("turn"))).alias("call_id"),
        F.when(user, F.lit(name)).alias("name"),
        F.when(user, F.to_json(F.struct("turn", "text"))).alias("arguments"),
        F.when(assistant, F.concat(F.col("conv_id"), F.lit(":"), F.col("turn") - 1)).alias("result_of"),
    )
