"""Chat formatting with linked tool calls, with DataFrame functions alone.

Calls are in the text of assistant turns, as ``{"content": ..., "tool_calls": [{"id", "name", "arguments": {...}}]}``;
results in turns of role ``tool``, as ``{"tool_call_id": ..., "content": ...}``. Results are hash-joined to calls by
(conversation, identifier). The order is topological: a result comes after its call, and a call whose arguments name
an earlier call as ``{"$result": id}`` comes after that call's result. Arguments are checked against the tools'
schemas. Each message becomes one line of canonical JSON: sorted keys, no blanks.

The result has one row a message, not one a conversation: a conversation that holds a third of all rows is no
larger task than others. Sorting by (conv_id, order_turn, order_depth, turn) gives the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import cut

CALLS = "struct<content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: JSON kinds of schema_of_variant, by the type names of tool schemas.
KINDS = {"string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": "BIGINT|DECIMAL.*|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
TOOL_SCHEMA = "name string, param string, type string, required boolean"


def _problems(args: Column, spec: Column) -> Column:
    """What is wrong with a call's arguments, sorted."""
    given = F.from_json(args, "map<string,variant>")
    names = F.map_keys(given)
    pattern = lambda t: F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), t)
    is_reference = lambda v: F.coalesce(F.to_json(v).startswith('{"$result":'), F.lit(False))  # noqa: E731  its type is that of a result
    missing = F.transform(F.filter(spec, lambda s: F.coalesce(s["required"], F.lit(False)) & ~F.array_contains(names, s["param"])), lambda s: F.concat(F.lit("missing:"), s["param"]))
    wrong = F.transform(
        F.filter(spec, lambda s: F.array_contains(names, s["param"]) & ~F.coalesce(F.regexp_like(F.schema_of_variant(F.element_at(given, s["param"])), F.concat(F.lit("^("), pattern(s["type"]), F.lit(")$"))), F.lit(False)) & ~is_reference(F.element_at(given, s["param"]))),
        lambda s: F.concat(F.lit("type:"), s["param"]),
    )
    unknown = F.transform(F.filter(names, lambda n: ~F.exists(spec, lambda s: s["param"] == n)), lambda n: F.concat(F.lit("unknown:"), n))
    broken = args.isNotNull() & F.try_parse_json(args).isNull()  # not JSON, or a name twice
    return F.when(spec.isNull(), F.array(F.lit("no such tool"))).when(broken, F.array(F.lit("arguments do not parse"))).when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))


def _order(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, mid, at) of each message of ``edges`` (conv_id, turn, mid, on_turn, on_mid); ``at`` is null on or behind a cycle.

    ``at`` is the largest (t, d) of the own (turn, 0) and of each awaited message's (t, d + 1). A round settles the
    messages that wait for nothing open, and lets the others look past each awaited message that waits for one
    message alone. So a chain takes as many rounds as its length has bits, and only messages that wait for several
    others take one each. A round that settles nothing leaves what is on or behind cycles.
    """
    key, on = ["conv_id", "turn", "mid"], ["on_turn", "on_mid"]
    open_ = edges.select(*key, *on, F.lit(1).cast("long").alias("k"))
    nodes = edges.select(*key).unionByName(edges.select("conv_id", F.col("on_turn").alias("turn"), F.col("on_mid").alias("mid"))).distinct()
    order = nodes.withColumn("at", F.struct(F.col("turn").alias("t"), F.lit(0).cast("long").alias("d")))
    settled = -1
    while True:
        # of a message that waits for one other: which, and how far
        left = open_.groupBy(*key).agg(F.count(F.lit(1)).alias("left"), F.first(F.struct(*on, "k")).alias("next"))
        order = cut(order.drop("left", "next").join(left, key, "left").withColumn("left", F.coalesce("left", F.lit(0))), "chat-order")
        before, settled = settled, order.filter("left = 0").count()
        if settled == before or open_.isEmpty():
            return order.select(*key, F.when(F.col("left") == 0, F.col("at")).alias("at"))
        awaited = order.select("conv_id", F.col("turn").alias("on_turn"), F.col("mid").alias("on_mid"), F.col("at").alias("by"), "left", "next")
        after = F.when(F.col("left") <= 1, F.struct(F.col("by.t").alias("t"), (F.col("by.d") + F.col("k")).alias("d")))
        past = F.when(F.col("left") > 1, F.struct(*on, "k"))
        past = past.when(F.col("left") == 1, F.struct(F.col("next.on_turn").alias("on_turn"), F.col("next.on_mid").alias("on_mid"), F.least(F.col("next.k") + F.col("k"), F.lit(1 << 40)).alias("k")))  # only cycles get there
        seen = cut(open_.join(awaited, ["conv_id", *on]).select(*key, after.alias("after"), past.alias("past")), "chat-waits")
        open_ = seen.filter("past is not null").groupBy(*key, F.col("past.on_turn").alias("on_turn"), F.col("past.on_mid").alias("on_mid")).agg(F.max("past.k").alias("k"))
        open_ = cut(open_, "chat-open")
        least = seen.groupBy(*key).agg(F.max("after").alias("after"))
        order = order.join(least, key, "left").withColumn("at", F.greatest("at", F.coalesce("after", "at"))).drop("after")


def format_chats(conversations: DataFrame, tools: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, order_turn, order_depth, role, kind, n_calls, n_problems, problems, linked, json.

    ``tools`` has name, param, type (of ``KINDS``), required; a tool without parameters has one row with a null param.
    ``kind``: message, calls, result or orphan (a result whose call is not there). Null roles and texts count as empty.
    Text that isn't of the JSON forms above is an ordinary message. Arguments that do not parse (or name a field twice) are
    a problem and stay as the text that they are; missing ones stay out. 1.0 counts as an integer, and is written as 1. Of calls that repeat an identifier the first by
    (turn, position) answers to it, the others are problems. Repeated messages stay. Calls that wait for
    each other, and messages behind them, keep the order of their turns and have the problem "cycle".
    """
    own = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("mid", F.xxhash64("role", "text"))
    is_json = F.ltrim("text").startswith("{")
    node = own.withColumn("c", F.when((F.col("role") == "assistant") & is_json, F.from_json("text", CALLS)))
    node = node.withColumn("r", F.when((F.col("role") == "tool") & is_json, F.from_json("text", RESULT)))
    key = ["conv_id", "turn", "mid"]

    calls = node.filter(F.size("c.tool_calls") > 0).dropDuplicates(key).select(*key, F.posexplode_outer("c.tool_calls").alias("idx", "call"))
    calls = cut(calls.select(*key, "idx", "call.id", "call.name", "call.arguments"), "chat-calls")  # parsed once
    first = calls.filter("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "idx", "mid")).alias("first"))
    specs = tools.groupBy("name").agg(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "type", "required"))).alias("spec"))
    checked = calls.join(specs, "name", "left").join(first, ["conv_id", "id"], "left")
    repeats = ~F.col("first").eqNullSafe(F.struct("turn", "idx", "mid"))
    checked = checked.withColumn("problems", F.concat(_problems(F.col("arguments"), F.col("spec")), F.when(F.col("id").isNull(), F.array(F.lit("no id"))).when(repeats, F.array(F.lit("id repeats"))).otherwise(F.array().cast("array<string>"))))

    results = node.filter("r.tool_call_id is not null").select(*key, F.col("r.tool_call_id").alias("id")).dropDuplicates(key)
    linked = cut(results.join(first, ["conv_id", "id"]).select(*key, F.col("first.turn").alias("call_turn"), F.col("first.mid").alias("call_mid"), "id"), "chat-links")

    # Order: key (turn, depth). A result is one deeper than its call unless its own turn is later anyway.
    refs = calls.select(*key, F.explode_outer(F.regexp_extract_all(F.coalesce("arguments", F.lit("")), F.lit(r'"\$result"\s*:\s*"([^"\\]+)"'), 1)).alias("id")).filter("id is not null").distinct()
    waits = refs.join(linked.select("conv_id", "id", F.col("turn").alias("on_turn"), F.col("mid").alias("on_mid")), ["conv_id", "id"]).drop("id")
    edges = linked.select(*key, F.col("call_turn").alias("on_turn"), F.col("call_mid").alias("on_mid")).unionByName(waits)
    edges = cut(edges.distinct(), "chat-edges")
    order = _order(edges).withColumn("cycle", F.col("at").isNull())

    per_message = checked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.array_sort(F.collect_list(F.struct("idx", F.transform("problems", lambda p: F.concat(F.coalesce("id", F.lit("?")), F.lit(" "), p)).alias("problems")))).alias("found"),
    )
    out = node.join(per_message, key, "left").join(linked.select(*key, "call_turn"), key, "left").join(order, key, "left")
    cycle = F.coalesce("cycle", F.lit(False))
    problems = F.concat(F.coalesce(F.flatten(F.transform("found", lambda f: f["problems"])), F.array().cast("array<string>")), F.when(cycle, F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    is_result = F.col("r.tool_call_id").isNotNull()
    kind = F.when(F.size("c.tool_calls") > 0, "calls").when(is_result & F.col("call_turn").isNotNull(), "result").when(is_result, "orphan").otherwise("message")
    shown = F.transform("c.tool_calls", lambda c: F.struct(F.coalesce(F.try_parse_json(c["arguments"]), c["arguments"].cast("variant")).alias("arguments"), c["id"].alias("id"), c["name"].alias("name")))
    json = F.to_json(F.struct(
        F.when(F.col("kind") == "calls", F.coalesce("c.content", F.lit(""))).when(is_result, F.coalesce("r.content", F.lit(""))).otherwise(F.col("text")).alias("content"),
        F.col("role"),
        F.when(is_result, F.col("r.tool_call_id")).alias("tool_call_id"),
        F.when(F.col("kind") == "calls", shown).alias("tool_calls"),
    ))
    return out.withColumn("kind", kind).select(
        "conv_id", "turn",
        F.coalesce("at.t", "turn").alias("order_turn"),
        F.coalesce(F.col("at.d").cast("int"), F.lit(0)).alias("order_depth"),
        "role", "kind",
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.size(problems).cast("long").alias("n_problems"), problems.alias("problems"),
        F.col("call_turn").isNotNull().alias("linked"), json.alias("json"),
    )
