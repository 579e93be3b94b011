"""Chat formatting with linked tool calls, in DataFrame operations only."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import written

#: What an assistant's or a tool's text may hold as JSON; anything else is plain text.
PAYLOAD = "content string, tool_call_id string, tool_calls array<struct<id string, name string, arguments string, depends_on array<string>>>"
#: Tools as JSON schemas: type, properties, required, items, enum, at any depth.
Schema = Mapping[str, Any]
TOOLS: Mapping[str, Schema] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}, "required": ["url"]},
}
#: The tool of the calls that ``question_calls`` makes of a conversation.
ANSWER: Mapping[str, Schema] = {
    "answer": {
        "type": "object",
        "properties": {
            "question": {"type": "string"},
            "size": {"type": "object", "properties": {"lines": {"type": "integer"}, "share": {"type": "number"}}, "required": ["lines"]},
            "kind": {"type": "string", "enum": ["long", "short"]},
        },
        "required": ["question", "size"],
    }
}
#: Rules that are broadcast; more are joined by a shuffle.
RULES = 5000
RULE = "tool string, path string, parent string, key string, type string, enum array<string>, closed boolean, items boolean, required boolean"


def rules_of(tools: Mapping[str, Schema]) -> list[tuple]:
    """A row of RULE for each place of the schemas: properties by ``a.b``, items of an array by ``a[]``."""
    out, todo = [], [(tool, "", None, None, schema, False) for tool, schema in tools.items()]
    while todo:
        tool, path, parent, key, schema, required = todo.pop()
        enum = [json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for v in schema["enum"]] if "enum" in schema else None
        out.append((tool, path, parent, key, schema.get("type"), enum, "properties" in schema, "items" in schema, required))
        for k, of in schema.get("properties", {}).items():
            todo.append((tool, f"{path}.{k}" if path else k, path, k, of, k in schema.get("required", ())))
        if "items" in schema:
            todo.append((tool, f"{path}[]", path, None, schema["items"], False))
    return out


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    if len(rules) > RULES:
        return spark.createDataFrame(rules, RULE)
    names = [f.split()[0] for f in RULE.split(", ")]
    rows = [F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kind).alias(n) for n, v, kind in zip(names, r, [f.split()[1] for f in RULE.split(", ")], strict=True)]) for r in rules]
    empty = F.array().cast(f"array<struct<{RULE.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>")
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows) if rows else empty)))


def json_type(value: Column) -> Column:
    """JSON type of a variant; a number without a fraction is an integer, however it is written."""
    kind, number = F.schema_of_variant(value), F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when((kind == "BIGINT") | (number == F.floor(number)), "integer")
        .when(number.isNotNull(), "number")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def canonical_number(token: Column) -> Column:
    """The shortest plain form of a JSON number: no plus sign, fraction or exponent without need; integers stay exact."""
    n = token.cast("double")
    plain = token.rlike(r"^-?[0-9]+$")
    whole = (n == F.floor(n)) & (F.abs(n) < 1e21)
    said = n.cast("string")
    sign, digits = F.when(n < 0, "-").otherwise(""), F.regexp_replace(F.regexp_replace(said, r"E.*$|[-.]", ""), r"0+$", "")
    e = F.regexp_extract(said, r"E(-?[0-9]+)$", 1).try_cast("int")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    large = F.concat(sign, F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(400)))
    far = F.concat(sign, F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(""), F.when(e > 0, "e+").otherwise("e"), e.cast("string"))
    return F.when(plain, F.when(n == 0, "0").otherwise(token)).when(whole, n.cast("decimal(38,0)").cast("string")).when(e.isNull(), said).when((e < 0) & (e >= -6), small).when((e >= 0) & (e < 21), large).otherwise(far)


def canonical_numbers(text: Column) -> Column:
    """JSON text with every number outside strings in its canonical form."""
    tokens = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|-?[0-9][-+.0-9eE]*|[^-"0-9]+'), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), canonical_number(t)).otherwise(t)), "")


def canonical(*pairs: tuple[str, Column]) -> Column:
    """A JSON object without white space, keys sorted at every depth, nulls written."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(pairs, key=lambda p: p[0])]), {"ignoreNullFields": "false"})


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ordered(calls: DataFrame, deps: DataFrame) -> DataFrame:
    """conv, call_id, at, level: a topological order of calls by (at, level); both null in a cycle or behind one.

    at is the latest turn of the call and of all that it waits for, level the longest chain of calls that it waits
    for. A round takes the calls settled by the last one off those that wait for them: as many rounds as the longest
    chain, each over the calls that still wait. A settled call is written once.
    """
    wait = deps.join(calls.select(F.col("conv").alias("c2"), F.col("call_id").alias("before")), same(F.col("conv"), F.col("c2")) & (F.col("needs") == F.col("before"))).select("conv", "call_id", "needs").distinct()
    if wait.isEmpty():
        return calls.select("conv", "call_id", F.col("turn").alias("at"), F.lit(0).alias("level"))
    wait = written(wait, "waits")
    missing = wait.groupBy(F.col("conv").alias("c2"), F.col("call_id").alias("i2")).agg(F.count(F.lit(1)).alias("open"))
    state = calls.join(missing, same(F.col("conv"), F.col("c2")) & (F.col("call_id") == F.col("i2")), "left").select("conv", "call_id", F.col("turn").alias("at"), F.lit(0).alias("level"), F.coalesce("open", F.lit(0)).alias("open"))
    state = written(state, "calls")
    settled = []
    while True:
        new = state.where("open = 0").select("conv", "call_id", "at", "level")
        settled.append(new)
        state = state.where("open > 0")
        if new.isEmpty() or state.isEmpty():
            break
        step = wait.join(new.select(F.col("conv").alias("c2"), F.col("call_id").alias("i2"), "at", "level"), same(F.col("conv"), F.col("c2")) & (F.col("needs") == F.col("i2")))
        step = step.groupBy(F.col("conv").alias("c3"), F.col("call_id").alias("i3")).agg(F.count(F.lit(1)).alias("done"), F.max("at").alias("late"), F.max("level").alias("deep"))
        moved = state.join(step, same(F.col("conv"), F.col("c3")) & (F.col("call_id") == F.col("i3")), "left")
        state = written(moved.select("conv", "call_id", F.greatest("at", "late").alias("at"), F.greatest("level", F.col("deep") + 1).alias("level"), (F.col("open") - F.coalesce("done", F.lit(0))).alias("open")), "calls")
    none = state.select("conv", "call_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("int").alias("level"))
    return reduce(DataFrame.unionByName, [*settled, none])


def argument_errors(calls: DataFrame, tools: Mapping[str, Schema]) -> DataFrame:
    """conv, call_id, errors: a sorted array of what the arguments break in their tool's schema.

    The values are taken apart level by level, as deep as the schemas go, and each level is joined with the rules.
    """
    spark, flat = calls.sparkSession, rules_of(tools)
    rules = rule_table(spark, flat)
    names = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in tools]).cast("array<string>")).alias("tool"))
    known = calls.select("conv", "call_id", "name", given_arguments(F.col("arguments")).alias("value")).join(F.broadcast(names), F.col("name") == F.col("tool"), "left")
    is_object = F.coalesce(json_type(F.col("value")) == "object", F.lit(False))
    errors = [known.select("conv", "call_id", F.when(F.col("tool").isNull(), "unknown tool").when(~is_object, "arguments are no object").alias("error"))]
    nodes = known.where(F.col("tool").isNotNull() & is_object).select("conv", "call_id", "tool", F.lit("").alias("path"), "value")
    own = ["conv", "call_id", "tool", "path"]
    for _ in range(1 + max((r[1].count(".") + r[1].count("[]") + (r[1] != "") for r in flat), default=0)):
        typed = nodes.join(rules.select(F.col("tool").alias("t2"), F.col("path").alias("p2"), "type", "enum", "closed", "items"), (F.col("tool") == F.col("t2")) & (F.col("path") == F.col("p2")), "left")
        typed = typed.withColumn("has", json_type(F.col("value")))
        fits = F.col("type").isNull() | (F.col("has") == F.col("type")) | ((F.col("type") == "number") & (F.col("has") == "integer"))
        listed = F.col("enum").isNull() | F.array_contains("enum", canonical_numbers(F.to_json(F.col("value"))))
        wrong = F.when(F.col("t2").isNull(), F.lit("unexpected ")).when(~fits, F.lit("type of ")).when(~listed, F.lit("value of "))
        errors.append(typed.select("conv", "call_id", F.concat(wrong, "path").alias("error")))
        within = typed.where((F.col("has") == "object") & F.col("closed")).select(*own, F.try_variant_get("value", "$", "map<string,variant>").alias("given"))
        needed = within.join(rules.where("required").select(F.col("tool").alias("t3"), "parent", "key", F.col("path").alias("p3")), (F.col("tool") == F.col("t3")) & (F.col("path") == F.col("parent")))
        errors.append(needed.where(~F.map_contains_key("given", F.col("key"))).select("conv", "call_id", F.concat(F.lit("missing "), "p3").alias("error")))
        inside = within.select(*own, F.explode("given").alias("key", "value")).select("conv", "call_id", "tool", F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), "value")
        each = typed.where((F.col("has") == "array") & F.col("items")).select(*own, F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("value"))
        nodes = inside.unionByName(each.withColumn("path", F.concat("path", F.lit("[]"))))
    every = reduce(DataFrame.unionByName, errors).where(F.col("error").isNotNull())
    return every.groupBy("conv", "call_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def given_arguments(text: Column) -> Column:
    """Arguments as a variant: an object, or an object written into a JSON string."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value) == "STRING", F.coalesce(F.try_parse_json(F.try_variant_get(value, "$", "string")), value)).otherwise(value)


def question_calls(conversations: DataFrame) -> DataFrame:
    """The rows of a plain conversation (conv_id, turn, role, text), and tool calls and results made of them.

    A user's turn calls the tool ``answer`` with its text, the number of its lines, the share of a page of 4000
    characters that it takes, and its kind (long from 400 characters, empty without a word); it waits for the first user's
    turn of the conversation. The next turn, if it is an assistant's, is the call's result. So conversations without tool
    calls exercise linking, order and validation in every row.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    asks = rows.where("role = 'user'")
    first = asks.groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("first"))
    asks = asks.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("text", F.coalesce("text", F.lit("")))
    size = F.length("text")
    kind = F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) == "", "empty").when(size >= 400, "long").otherwise("short")
    arguments = F.struct(F.col("text").alias("question"), F.struct(F.size(F.split("text", "\n")).alias("lines"), (size / 4000).alias("share")).alias("size"), kind.alias("kind"))
    name = lambda turn: F.concat(F.lit("q"), turn.cast("string"))
    waits = F.when(F.col("turn") > F.col("first"), F.array(name(F.col("first"))))
    call = F.struct(name(F.col("turn")).alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"), waits.alias("depends_on"))
    calls = asks.select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content"))).alias("text"))
    return rows.unionByName(calls).unionByName(results)


def format_chats(conversations: DataFrame, tools: Mapping[str, Schema] = TOOLS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Events of conversations: conv_id, at, level, place, step, turn, kind, role, call_id, status, errors, json.

    An assistant's text that is a JSON object with ``tool_calls`` (id, name, arguments as object or JSON string,
    depends_on) gives a message and its calls; a tool's text that is one with ``tool_call_id`` gives a result; any
    other text is a message. Sorted by (at, level, place, step) within a conversation, every call comes after the
    calls that it depends on and every result after its call. One row an event, so a long conversation is no group.

    status: ``ok``; of calls ``invalid`` (see errors), ``unanswered``, ``cyclic`` (at is then its own turn);
    ``repeated`` for further calls or results with an id already used (the first by turn and place counts);
    ``orphan`` for results without a call of their id. Links hold within one conversation; null conversations form
    one, null or empty ids link with nothing. Repeated rows are repeated events. Null texts are empty content
    (JSON null), null turns sort first. Calls that tie in (at, level, place) depend on none of each other. Empty tables
    give no events; other columns are not read. A text is parsed as one row, so a task takes memory for the longest.
    """
    own = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    maybe = F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{")
    own = own.withColumn("p", F.when(maybe, F.from_json("text", PAYLOAD)))
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size("p.tool_calls") > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & (F.col("p.tool_call_id") != ""), F.lit(False))
    content = F.when(is_call, F.col("p.content")).otherwise(F.col("text"))
    none = F.array().cast("array<string>")
    columns = ["conv", "at", "level", "place", "step", "turn", "kind", "role", "call_id", "status", "errors", "json"]

    messages = own.where(~is_result).select(
        "conv", F.col("turn").alias("at"), F.lit(-1).alias("level"), F.lit(0).alias("place"), F.lit(0).alias("step"), "turn", F.lit("message").alias("kind"), "role",
        F.lit(None).cast("string").alias("call_id"), F.lit("ok").alias("status"), none.alias("errors"), canonical(("content", content), ("role", F.col("role")), ("turn", F.col("turn"))).alias("json"))

    said = own.where(is_call).select("conv", "turn", "role", F.posexplode("p.tool_calls").alias("place", "c")).select("conv", "turn", "role", "place", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    spot = F.struct("turn", "place", F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")))
    linked = said.where(F.col("call_id") != "").groupBy("conv", "call_id").agg(F.min_by(F.struct("turn", "place", "name", "arguments", "depends_on"), spot).alias("w")).select("conv", "call_id", "w.*")
    linked = written(linked, "calls")
    deps = linked.select("conv", "call_id", F.explode("depends_on").alias("needs"))
    order = ordered(linked, deps).select(F.col("conv").alias("oc"), F.col("call_id").alias("oi"), "at", "level")
    errors = argument_errors(linked, tools).select(F.col("conv").alias("ec"), F.col("call_id").alias("ei"), "errors")
    results = own.where(is_result).select("conv", "turn", "role", F.col("p.tool_call_id").alias("call_id"), F.col("p.content").alias("content"))
    answered = results.select(F.col("conv").alias("rc"), F.col("call_id").alias("ri")).distinct().withColumn("answered", F.lit(True))
    facts = linked.select("conv", "call_id", F.col("turn").alias("first_turn"), F.col("place").alias("first_place"))
    facts = facts.join(order, same(F.col("conv"), F.col("oc")) & (F.col("call_id") == F.col("oi")), "left")
    facts = facts.join(errors, same(F.col("conv"), F.col("ec")) & (F.col("call_id") == F.col("ei")), "left")
    facts = facts.join(answered, same(F.col("conv"), F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    facts = written(facts.select(F.col("conv").alias("fc"), F.col("call_id").alias("fi"), "first_turn", "first_place", F.coalesce("at", "first_turn").alias("fa"), F.col("level").alias("fl"), "errors", "answered"), "facts")
    link = same(F.col("conv"), F.col("fc")) & (F.col("call_id") == F.col("fi"))

    first = same(F.col("turn"), F.col("first_turn")) & (F.col("place") == F.col("first_place"))
    known = F.col("fi").isNotNull()
    status = F.when(~known, "orphan").when(~first, "repeated").when(F.col("fl").isNull(), "cyclic").when(F.size("errors") > 0, "invalid").when(F.col("answered"), "ok").otherwise("unanswered")
    arguments = given_arguments(F.col("arguments"))
    calls = said.join(facts, link, "left").select(
        "conv", F.when(first & known, F.col("fa")).otherwise(F.col("turn")).alias("at"), F.when(first & known, F.coalesce("fl", F.lit(0))).otherwise(F.lit(0)).alias("level"), "place", F.lit(1).alias("step"), "turn",
        F.lit("call").alias("kind"), "role", "call_id", status.alias("status"), F.coalesce("errors", none).alias("errors"), canonical_numbers(canonical(("arguments", arguments), ("id", F.col("call_id")), ("name", F.col("name")))).alias("json"))

    earliest = results.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("e")).select(F.col("conv").alias("c4"), F.col("call_id").alias("i4"), F.col("e.turn").alias("e_turn"), F.col("e.content").alias("e_content"))
    got = results.join(facts, link, "left").join(earliest, same(F.col("conv"), F.col("c4")) & (F.col("call_id") == F.col("i4")), "left")
    late = F.col("fi").isNotNull()
    is_first = same(F.col("turn"), F.col("e_turn")) & same(F.col("content"), F.col("e_content"))
    result_status = F.when(~late, "orphan").when(is_first, "ok").otherwise("repeated")
    replies = got.select(
        "conv", F.when(late, F.greatest("fa", "turn")).otherwise(F.col("turn")).alias("at"), F.when(late, F.coalesce("fl", F.lit(0))).otherwise(F.lit(0)).alias("level"), F.coalesce("first_place", F.lit(0)).alias("place"), F.lit(2).alias("step"), "turn",
        F.lit("result").alias("kind"), "role", "call_id", result_status.alias("status"), none.alias("errors"), canonical(("content", F.col("content")), ("role", F.col("role")), ("tool_call_id", F.col("call_id")), ("turn", F.col("turn"))).alias("json"))
    every = messages.unionByName(calls).unionByName(replies).select(*columns)
    return every.withColumnRenamed("conv", conv_col)


#: DuckDB SQL for the registered query: the events of ``question_calls``.
ORACLE = """
WITH q AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS t FROM conversations),
f AS (SELECT conv_id, min(turn) AS first FROM q WHERE role = 'user' GROUP BY conv_id),
c AS (
  SELECT q.conv_id AS conv_id, q.turn AS turn, q.t AS t, cast(q.turn > first AS INTEGER) AS level, a.turn IS NOT NULL AS answered, cast(length(q.t) / 4000.0 AS DOUBLE) AS share,
    CASE WHEN trim(regexp_replace(q.t, '\\s+', ' ', 'g')) = '' THEN 'empty' WHEN length(q.t) >= 400 THEN 'long' ELSE 'short' END AS kind
  FROM q JOIN f ON q.conv_id = f.conv_id LEFT JOIN q a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')
SELECT conv_id, turn AS "at", -1 AS level, 0 AS place, 0 AS step, turn, 'message' AS kind, role, NULL::VARCHAR AS call_id, 'ok' AS status, []::VARCHAR[] AS errors,
  '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '","turn":' || turn || '}' AS json FROM q
UNION ALL
SELECT conv_id, turn, -1, 0, 0, turn, 'message', 'assistant', NULL, 'ok', [], '{"content":null,"role":"assistant","turn":' || turn || '}' FROM c
UNION ALL
SELECT conv_id, turn, level, 0, 1, turn, 'call', 'assistant', 'q' || turn, CASE WHEN kind = 'empty' THEN 'invalid' WHEN answered THEN 'ok' ELSE 'unanswered' END,
  CASE WHEN kind = 'empty' THEN ['value of kind'] ELSE [] END,
  '{"arguments":{"kind":"' || kind || '","question":' || to_json(t)::VARCHAR || ',"size":{"lines":' || len(string_split(t, chr(10))) || ',"share":' || CASE WHEN share = floor(share) THEN share::BIGINT::VARCHAR ELSE share::VARCHAR END || '}},"id":"q' || turn || '","name":"answer"}'
FROM c
UNION ALL
SELECT q.conv_id, q.turn, coalesce(level, 0), 0, 2, q.turn, 'result', 'tool', 'q' || (q.turn - 1), CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'ok' END, [],
  '{"content":' || to_json(q.t)::VARCHAR || ',"role":"tool","tool_call_id":"q' || (q.turn - 1) || '","turn":' || q.turn || '}'
FROM q LEFT JOIN c ON c.conv_id = q.conv_id AND c.turn = q.turn - 1 WHERE q.role = 'assistant'
"""
