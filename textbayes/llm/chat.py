"""Chat formatting: links tool calls with their results, orders them, validates arguments and writes canonical JSON.

A message's text may be a JSON object: with `tool_calls`, an array of {id, name, arguments} or {id, type, function: {name, arguments}}, or, for
role `tool`, with `tool_call_id` and content. Arguments are an object, or a string that holds one. Calls and results meet in a hash join on
(conversation, id); only results and calls take part in it, so plain messages, however many a conversation has, are never shuffled. Texts are
parsed as variants; schemas become one column expression each. All is built-in SQL expressions.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema language's types and the types of JSON values they take.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}
#: The parts of JSON schemas that are understood; others are an error.
KEYS = {"type", "enum", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "minLength", "maxLength", "pattern", "description"}
#: An example of tools: {name: schema of the arguments}. Objects take no other properties than they name unless additionalProperties is true.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 4}}, "required": ["query"]},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string"}, "mode": {"enum": ["exact", "rounded"]}}, "required": ["expression"]},
    "fetch": {
        "type": "object",
        "properties": {
            "url": {"type": "string", "pattern": "^https?://"},
            "timeout": {"type": "number"},
            "headers": {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string"}, "value": {"type": ["string", "null"]}}, "required": ["name"]}},
        },
        "required": ["url"],
    },
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def kind_of(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def fits(v: Column, schema: dict) -> Column:
    """Whether a JSON value (a variant) fits a schema; never null."""
    if unknown := schema.keys() - KEYS:
        raise ValueError(f"schemas with {sorted(unknown)} aren't understood")
    get = lambda kind, path="$": F.try_variant_get(v, path, kind)
    tests = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        tests.append(kind_of(v).isin([k for n in names for k in TYPES[n]]))
    if "enum" in schema:
        tests.append(F.to_json(v).isin([json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in schema["enum"]]))
    # what follows holds for values of one type and leaves others alone
    of = lambda kinds, test: F.when(kind_of(v).isin(kinds), F.coalesce(test, F.lit(False))).otherwise(True)
    for key, kind, test in (
        ("minimum", "double", lambda x, n: x >= n), ("maximum", "double", lambda x, n: x <= n), (
            "minLength", "string", lambda x, n: F.length(x) >= n
        ), ("maxLength", "string", lambda x, n: F.length(x) <= n),
        ("pattern", "string", lambda x, p: x.rlike(p)), ("minItems", "array<variant>", lambda x, n: F.size(x) >= n), ("maxItems", "array<variant>", lambda x, n: F.size(x) <= n), (
            "items", "array<variant>", lambda x, s: F.forall(x, lambda i: fits(i, s))
        ),
    ):
        if key in schema:
            tests.append(of(TYPES["number"] if kind == "double" else TYPES["string"] if kind == "string" else TYPES["array"], test(get(kind), schema[key])))
    if "properties" in schema or "required" in schema:
        properties = schema.get("properties", {})

        def held(names):
            out = F.size(F.array_except(F.array(*map(F.lit, schema.get("required", []))).cast("array<string>"), names)) == 0
            if not schema.get("additionalProperties", False):
                out &= F.size(F.array_except(names, F.array(*map(F.lit, properties)).cast("array<string>"))) == 0
            for name, inner in properties.items():
                out &= F.when(F.array_contains(names, name), let(get("variant", f"$[{json.dumps(name)}]"), partial(_fits, inner))).otherwise(True)
            return out

        tests.append(of(["OBJECT"], let(F.map_keys(get("map<string,variant>")), held)))
    out = F.lit(True)
    for test in tests:
        out &= F.coalesce(test, F.lit(False))
    return out


def _fits(schema: dict, v: Column) -> Column:
    return fits(v, schema)


def calls_of(v: Column) -> Column:
    """A message's calls as structs of id, name and arguments (a variant), all null where an element isn't a call."""

    def call(c):
        name = F.coalesce(F.try_variant_get(c, "$.function.name", "string"), F.try_variant_get(c, "$.name", "string"))
        given = F.coalesce(F.try_variant_get(c, "$.function.arguments", "variant"), F.try_variant_get(c, "$.arguments", "variant"))
        inside = let(given, lambda a: F.when(kind_of(a) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(a, "$", "string")), a)).otherwise(a))
        return F.struct(F.try_variant_get(c, "$.id", "string").alias("id"), name.alias("name"), inside.alias("arguments"))

    return F.transform(F.try_variant_get(v, "$.tool_calls", "array<variant>"), call)


def _valid(call: Column, tools: dict) -> Column:
    """Whether a call names a known tool and its arguments are an object that fits the tool's schema."""
    out = F.lit(False)
    for tool, schema in tools.items():
        out = F.when(call["name"] == tool, (kind_of(call["arguments"]) == "OBJECT") & fits(call["arguments"], schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def chat_format(messages: DataFrame, tools: dict | None = None) -> DataFrame:
    """messages(conv_id, turn, role, text, ...) -> one row for each: (conv_id, turn, role, order_turn, order_step, n_calls, n_valid, linked, json).

    order_turn, order_step, turn put a conversation's messages in a topological order: a result stands after its call even if its turn is
    before it, all else keeps its turn. n_calls and n_valid count the calls of an assistant's message (an element that is no call counts as one that
    isn't valid) and those whose arguments fit the tool's schema; linked tells whether a tool's result has a call with its id (null for other messages).
    json has sorted keys: content and role; of calls also tool_calls, of results tool_call_id and name. Null texts and roles become empty strings; texts of any
    length are taken whole. Of calls that share an id in a conversation the earliest counts (then the first in its message); results that share one all link
    to it. Texts that aren't such objects are plain messages, as are those without conversation or id. Repeated rows come back as often as they
    stand there, an empty table gives an empty result, other columns are ignored.
    """
    tools = TOOLS if tools is None else tools
    rows = messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    looks = F.col("text").rlike(r"^\s*\{") & F.col("text").contains('"tool_call')
    rows = rows.withColumn("v", F.when(looks, F.try_parse_json("text")))
    calls = F.when((F.col("role") == "assistant") & F.col("v").isNotNull(), calls_of(F.col("v")))
    answer = F.when((F.col("role") == "tool") & F.col("v").isNotNull(), F.try_variant_get("v", "$.tool_call_id", "string"))
    rows = rows.withColumn("calls", calls).withColumn("call_id", answer)

    named = F.transform("calls", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name")))
    made = rows.where("calls is not null").select(
        "conv_id", "turn", F.posexplode(named).alias("place", "call")
    ).where("call.id is not null and conv_id is not null")
    first = made.groupBy("conv_id", F.col("call.id").alias("call_id")).agg(F.min(F.struct("turn", "place", F.col("call.name").alias("name"))).alias("first"))
    is_result = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    results = rows.where(is_result).join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    moved = F.col("first.turn") >= F.col("turn")
    content = F.coalesce(F.try_variant_get("v", "$.content", "string"), F.to_json(F.try_variant_get("v", "$.content", "variant")), F.lit(""))
    results = results.select(
        "conv_id", "turn", "role", F.coalesce(
            F.when(moved, F.col("first.turn")), "turn"
        ).alias("order_turn"), F.when(moved, 1).otherwise(0).alias("order_step"),
        F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_valid"), F.col("first").isNotNull().alias("linked"),
        F.to_json(F.struct(
            content.alias("content"), F.coalesce("first.name", F.lit("")).alias("name"), "role", F.col("call_id").alias("tool_call_id")
        )).alias("json"),
    )
    listed = F.transform(
        "calls",
        lambda c: F.struct(c["arguments"].alias("arguments"), F.coalesce(c["id"], F.lit("")).alias("id"), F.coalesce(c["name"], F.lit("")).alias("name"), _valid(c, tools).alias("valid"))
    )
    others = rows.where(~is_result).withColumn("listed", F.when(F.size("calls") > 0, listed))
    said = F.coalesce(F.when(F.col("listed").isNotNull(), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit(""))), "text")
    with_calls = F.to_json(F.struct(said.alias("content"), "role", F.col("listed").alias("tool_calls")))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    valid = F.filter(F.transform("listed", lambda c: c["valid"]), lambda ok: ok)
    others = others.select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_step"), F.greatest(
            count(F.col("listed")), F.lit(0)
        ).alias("n_calls"),
        F.greatest(count(valid), F.lit(0)).alias("n_valid"), F.lit(None).cast("boolean").alias("linked"), F.when(
            F.col("listed").isNotNull(), with_calls
        ).otherwise(plain).alias("json"),
    )
    return others.unionByName(results)


def with_tools(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) whose assistants call tools and whose users' turns are the results, by rules of turn and length of the text.

    An assistant's turn calls a tool that its number chooses, with arguments that fit the schema or break it in one of several ways, in either
    form, with or without id, some next to an element that is no call; a user's turn answers the turn before or, ahead of it, the one after. Other
    roles stay. Null texts count as empty.
    """
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    size = F.length(text)
    k, at = size % 6, F.pmod(turn, F.lit(4))
    search = F.to_json(F.struct(k.cast("long").alias("limit"), F.substring(text, 1, 20).alias("query")))
    calculator = F.to_json(F.struct(F.substring(text, 1, 10).alias("expression"), F.when(k % 2 == 0, "exact").otherwise("guessed").alias("mode")))
    header = F.struct(F.when(k != 3, "accept").alias("name"), F.lit("text").alias("value"))
    url = F.when(k != 4, F.concat(F.lit("https://host.example/"), turn.cast("string")))
    fetch = F.to_json(F.struct(F.array(header).alias("headers"), url.alias("url")))
    name = F.when(at == 1, "search").when(at == 3, "calculator").otherwise("fetch")
    arguments = F.when(at == 1, search).when(at == 3, calculator).otherwise(fetch)
    call_id = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    as_json = lambda s: F.to_json(F.struct(s.alias("s")))
    quoted = lambda s: F.regexp_extract(as_json(s), r'(?s)^\{"s":(.*)\}$', 1)
    id_ = F.when(k == 5, F.lit("")).otherwise(F.concat(F.lit('"id":'), quoted(call_id(turn)), F.lit(",")))
    nested = F.concat(F.lit("{"), id_, F.lit('"type":"function","function":{"name":'), quoted(name), F.lit(',"arguments":'), quoted(arguments), F.lit("}}"))
    flat = F.concat(F.lit("{"), id_, F.lit('"name":'), quoted(name), F.lit(',"arguments":'), arguments, F.lit("}"))
    calls = F.concat(F.when(k % 2 == 0, nested).otherwise(flat), F.when(k == 2, ",7").otherwise(""))
    asked = F.concat(F.lit('{"tool_calls":['), calls, F.lit('],"content":'), quoted(text), F.lit("}"))
    target = F.when(at == 2, turn - 1).otherwise(turn + 1)
    told = F.when(size % 2 == 0, quoted(text)).otherwise(F.concat(F.lit('{"text":'), quoted(text), F.lit(',"n":'), size.cast("string"), F.lit("}")))
    answered = F.concat(F.lit('{"tool_call_id":'), quoted(call_id(target)), F.lit(',"content":'), told, F.lit("}"))
    return conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "assistant", asked).when(F.col("role") == "user", answered).otherwise(F.col("text")).alias("text"),
    )
