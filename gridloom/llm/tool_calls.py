"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON.

An assistant's message may be a JSON object with ``tool_calls``: a list of
{"id", "name", "arguments", "after"}, where ``arguments`` is an object (or its
JSON as text) and ``after`` lists ids of calls of the conversation whose results
it needs. A tool's message is {"tool_call_id", "content"}.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.tables import stash

_CALLS = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, after: array<string>>>>"
_RESULT = "struct<tool_call_id: string, content: string>"
#: Turns of a conversation whose calls are numbered in one task.
TURNS = 1_000

#: Types of a schema, as the type of a parsed value is called.
_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY%", "object": "OBJECT%", "integer": "BIGINT", "null": "VOID"}


def calls_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, place, call_id, name, arguments, after) of all calls of assistant messages; text that is no such JSON holds none."""
    parsed = F.from_json("text", _CALLS)["tool_calls"]
    calls = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(parsed).alias("place", "call"))
    return calls.select("conv_id", "turn", "place", F.col("call.id").alias("call_id"), "call.name", "call.arguments", "call.after")


def results_of(messages: DataFrame) -> DataFrame:
    """(conv_id, call_id, result_turn, result) of all tool messages; the text itself, and a null id, where it names no call."""
    found = messages.where("role = 'tool'").select("conv_id", "turn", "text", F.from_json("text", _RESULT).alias("r"))
    content = F.when(F.col("r.tool_call_id").isNull(), F.col("text")).otherwise(F.col("r.content"))
    return found.select("conv_id", F.col("r.tool_call_id").alias("call_id"), F.col("turn").alias("result_turn"), content.alias("result"))


def _matched(messages: DataFrame) -> DataFrame:
    """All calls and results: (conv_id, call_id, is_call, turn, place, name, arguments, after, result, rep, nth).

    ``rep`` numbers the calls of a conversation that share an id, from 0; a
    result has that of the latest call of its id that is no later, -1 where
    there is none. ``nth`` numbers the results of a call from 1.
    """
    calls = calls_of(messages).withColumns({"is_call": F.lit(True), "result": F.lit(None).cast("string")})
    results = results_of(messages).withColumnsRenamed({"result_turn": "turn"}).withColumn("is_call", F.lit(False))
    both = calls.unionByName(results, allowMissingColumns=True)
    same = Window.partitionBy("conv_id", "call_id").orderBy("turn", F.col("is_call").desc(), "place", "name", "arguments", "after", "result")
    count = F.sum(F.col("is_call").cast("int")).over(same.rowsBetween(Window.unboundedPreceding, 0)) - 1
    # Calls without an id are numbered like others, so that each is one; results without an id are of none of them.
    rep = F.when(F.col("call_id").isNull() & ~F.col("is_call"), F.lit(-1)).otherwise(count).cast("int")
    numbered = both.withColumn("rep", rep)
    of_call = Window.partitionBy("conv_id", "call_id", "rep", "is_call").orderBy("turn", "result")
    return numbered.withColumn("nth", F.row_number().over(of_call))


def _key() -> Column:
    """One text for each call of a conversation."""
    return F.concat(F.col("rep").cast("string"), F.coalesce(F.concat(F.lit(":"), "call_id"), F.lit("")))


def link(messages: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row for each call of ``messages`` (conv_id, turn, role, text), and for each result that no call takes.

    (conv_id, turn, call_id, name, position, errors, result_turn, canonical).
    Calls are joined to results by conversation and id; a call without a result
    has null result_turn and "result":null. ``position`` counts a conversation's
    calls from 0 in an order in which every call follows those it needs, and is
    otherwise the order of turns; calls that need each other in a circle keep
    their turn's place and say so in ``errors``, as do unknown ids, tools and
    arguments, and wrong types. ``canonical`` has keys in order, no white space.
    Null conversations and turns are values of their own, before all others.

    Ids may repeat in a conversation: a result, and a call that needs the id, is
    joined to the latest earlier call of it (a need, if there is none, to the
    first). Later calls of an id, and calls without one, say so in ``errors``.
    Further results of a call, and results that no earlier call matches, are rows
    with null turn, call_id, name and position; their id is in ``canonical``.
    """
    every = stash(_matched(messages).withColumn("key", _key()), "tool-calls")
    calls = every.where("is_call").drop("result").alias("c")
    taken = ~F.col("is_call") & (F.col("rep") >= 0) & (F.col("nth") == 1)
    results = every.where(taken).select(F.col("conv_id").alias("r_conv"), F.col("key").alias("r_key"), F.col("turn").alias("result_turn"), "result")
    joined = calls.join(results, calls["conv_id"].eqNullSafe(results["r_conv"]) & (calls["key"] == results["r_key"]), "left")
    joined = joined.select("c.*", "result_turn", "result")
    order = _order(calls.select("conv_id", "turn", "place", "call_id", "key", "rep", "after"))
    order = order.select(F.col("conv_id").alias("of_conv"), F.col("call_id").alias("of_call"), "slot", "level", "unknown", "circle")
    joined = joined.join(order, joined["conv_id"].eqNullSafe(order["of_conv"]) & (joined["key"] == order["of_call"]))
    value = F.try_parse_json("arguments")
    shaped = F.when(F.expr("schema_of_variant(args) like 'OBJECT%'"), F.col("args"))
    joined = _numbered(joined).withColumn("args", value).withColumn("args", shaped)
    errors = F.concat(
        _violations(schemas), F.transform("unknown", lambda i: F.concat(F.lit("unknown call "), i)),
        F.when(F.col("circle"), F.array(F.lit("circle"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("call_id").isNull(), F.array(F.lit("call without id"))).when(F.col("rep") > 0, F.array(F.concat(F.lit("repeated id "), "call_id")))
        .otherwise(F.array().cast("array<string>")))
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("args"), F.lit("null")), F.lit(',"id":'), _quoted("call_id"),
        F.lit(',"name":'), _quoted("name"), F.lit(',"result":'), _quoted("result"), F.lit("}"))
    linked = joined.select("conv_id", "turn", "call_id", "name", "position", errors.alias("errors"), "result_turn", canonical.alias("canonical"))
    what = F.when(F.col("call_id").isNull(), F.lit("result without id")).when(
        F.col("rep") < 0, F.concat(F.lit("result without call "), "call_id")).otherwise(F.concat(F.lit("surplus result of "), "call_id"))
    alone = F.concat(
        F.lit('{"arguments":null,"id":'), _quoted("call_id"), F.lit(',"name":null,"result":'), _quoted("result"), F.lit("}"))
    none = {c: F.lit(None).cast(linked.schema[c].dataType) for c in ("turn", "call_id", "name", "position")}
    rest = every.where(~F.col("is_call") & ~taken).select(
        "conv_id", none["turn"].alias("turn"), none["call_id"].alias("call_id"), none["name"].alias("name"), none["position"].alias("position"),
        F.array(what).alias("errors"), F.col("turn").alias("result_turn"), alone.alias("canonical"))
    return linked.union(rest)


def _quoted(name: str) -> Column:
    return F.coalesce(F.to_json(F.col(name).cast("variant")), F.lit("null"))


def _violations(schemas: Mapping[str, Mapping]) -> Column:
    """What is wrong with ``args`` under the schema of tool ``name``."""
    checks = F.when(F.col("args").isNull(), F.array(F.lit("arguments are no object")))
    for tool, schema in schemas.items():
        found = []
        properties = schema.get("properties", {})
        for name in schema.get("required", ()):
            found.append(F.when(F.expr(_get(name)).isNull(), F.lit(f"{name} is missing")))
        for name, rule in properties.items():
            present = F.expr(_get(name)).isNotNull()
            found += [F.when(present & ~F.coalesce(ok, F.lit(False)), F.lit(f"{name}: {what}")) for what, ok in _rules(name, rule)]
        if schema.get("additionalProperties", True) is False:
            names = F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>")
            extra = F.array_except(F.json_object_keys(F.to_json("args")), names)
            found.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(extra), ","))))
        listed = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array()
        checks = checks.when(F.col("name") == tool, listed.cast("array<string>"))
    return checks.otherwise(F.array(F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("null")))))


def _get(name: str, kind: str = "variant") -> str:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"try_variant_get(args, '$[\"{quoted}\"]', '{kind}')"


def _rules(name: str, rule: Mapping) -> list[tuple[str, Column]]:
    kind = F.expr(f"schema_of_variant({_get(name)})")
    out = []
    if rule.get("type") == "number":
        out.append(("not a number", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")))
    elif "type" in rule:
        out.append((f"not {rule['type']}", kind.like(_TYPES[rule["type"]])))
    number = F.expr(_get(name, "double"))
    if "minimum" in rule:
        out.append((f"below {rule['minimum']}", number >= rule["minimum"]))
    if "maximum" in rule:
        out.append((f"above {rule['maximum']}", number <= rule["maximum"]))
    if "enum" in rule:
        out.append(("not one of the values", F.expr(_get(name, "string")).isin(list(rule["enum"]))))
    return out


def _order(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, slot, level, unknown, circle): sorted by slot and level, calls follow what they need.

    A slot is (turn, place) of the latest call among a call and all it needs,
    directly or not; among calls of one slot the level counts the steps. Only
    calls that come before something they need change from one round to the
    next, so rounds number the longest chain of such calls; usually one looks
    and finds none. A call that inherits its own slot needs itself. ``call_id``
    of the result, and from here on, is the key of a call.
    """
    own = F.struct("turn", "place").alias("slot")
    start = calls.select("conv_id", F.col("key").alias("call_id"), own, F.lit(0).alias("level"), F.lit(False).alias("circle"))
    wants = calls.select("conv_id", F.col("key").alias("wanting"), own, F.explode(F.array_distinct("after")).alias("needed"))
    there = calls.where("call_id is not null").select("conv_id", F.col("call_id").alias("needed"), own, F.lit(1).alias("is_call"))
    both = there.unionByName(wants.withColumn("is_call", F.lit(0)), allowMissingColumns=True)
    same = Window.partitionBy("conv_id", "needed")
    before = F.sum("is_call").over(same.orderBy("slot", "is_call").rowsBetween(Window.unboundedPreceding, 0))
    wants = both.withColumns({"rep": F.greatest(before - 1, F.lit(0)).cast("int"), "some": F.sum("is_call").over(same) > 0}).where("is_call = 0")
    wants = wants.withColumn("call_id", F.col("needed")).withColumn("needed_key", F.when(F.col("some"), _key()))
    needed = calls.select(F.col("conv_id").alias("in_conv"), F.col("key").alias("there"), F.struct("turn", "place").alias("needed_slot"))
    edges = wants.join(needed, wants["conv_id"].eqNullSafe(needed["in_conv"]) & (wants["needed_key"] == needed["there"]), "left")
    edges = edges.select("conv_id", F.col("wanting").alias("call_id"), "slot", "needed", "needed_key", "needed_slot", F.col("there").isNull().alias("unknown"))
    edges = stash(edges, "call-needs")
    lost = edges.where("unknown").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("needed")).alias("unknown"))
    # All needed calls come earlier: every call has its own slot.
    late = edges.where(~F.col("unknown") & (F.col("needed_slot") >= F.col("slot")))
    state = start
    if not late.isEmpty():
        known = edges.where("not unknown").select(F.col("conv_id").alias("e_conv"), F.col("call_id").alias("e_call"), F.col("needed_key").alias("needed"))
        state = stash(start.withColumn("own", F.col("slot")), "call-order")
        while True:
            before = state.select("conv_id", F.col("call_id").alias("needed"), F.struct("slot", (F.col("level") + 1).alias("level")).alias("at"))
            inherited = known.join(before, known["e_conv"].eqNullSafe(before["conv_id"]) & (known["needed"] == before["needed"]))
            inherited = inherited.groupBy("e_conv", "e_call").agg(F.max("at").alias("at"))
            moved = state.join(inherited, state["conv_id"].eqNullSafe(inherited["e_conv"]) & (state["call_id"] == inherited["e_call"]), "left")
            circle = F.col("circle") | F.coalesce(F.col("at.slot") == F.col("own"), F.lit(False))
            at = F.when(circle | F.col("at").isNull(), F.struct(F.col("own").alias("slot"), F.lit(0).alias("level"))).otherwise(
                F.greatest("at", F.struct(F.col("own").alias("slot"), F.lit(0).alias("level"))))
            moved = moved.select("conv_id", "call_id", "own", circle.alias("now_circle"), at.alias("now"), "slot", "level", "circle")
            changed = ~(F.col("now.slot").eqNullSafe(F.col("slot")) & (F.col("now.level") == F.col("level")) & (F.col("now_circle") == F.col("circle")))
            moved = stash(moved.withColumn("changed", changed), "call-order")
            state = moved.select("conv_id", "call_id", F.col("now.slot").alias("slot"), F.col("now.level").alias("level"), F.col("now_circle").alias("circle"), "own")
            if moved.where("changed").isEmpty():
                break
    lost = lost.select(F.col("conv_id").alias("l_conv"), F.col("call_id").alias("l_call"), "unknown")
    state = state.join(lost, state["conv_id"].eqNullSafe(lost["l_conv"]) & (state["call_id"] == lost["l_call"]), "left")
    return state.select("conv_id", "call_id", "slot", "level", "circle", F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))


def _numbered(calls: DataFrame) -> DataFrame:
    """``position`` by slot and level, counted in runs of turns, so that a long conversation is no single task."""
    run = F.floor(F.coalesce(F.col("slot.turn"), F.lit(-1)) / TURNS).alias("run")
    calls = calls.withColumn("run", run)
    counts = calls.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("conv_id").orderBy("run")) - F.col("n")
    starts = counts.select(F.col("conv_id").alias("s_conv"), F.col("run").alias("s_run"), start.alias("start"))
    place = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("slot", "level", "turn", "place", "key")) - 1
    numbered = calls.withColumn("n", place)
    joined = numbered.join(starts, numbered["conv_id"].eqNullSafe(starts["s_conv"]) & (numbered["run"] == starts["s_run"]))
    return joined.withColumn("position", (F.col("start") + F.col("n")).cast("long"))


#: The tools of the query, which reads every assistant's turn as a call of one of them.
SCHEMAS = {
    "note": {"properties": {"text": {"type": "string"}, "chars": {"type": "integer", "minimum": 1, "maximum": 199}},
             "required": ["text", "chars"], "additionalProperties": False},
    "answer": {"properties": {"text": {"type": "string"}, "chars": {"type": "integer", "minimum": 200}},
               "required": ["text", "chars"], "additionalProperties": False},
}


def as_messages(conversations: DataFrame) -> DataFrame:
    """Plain ``conversations`` as messages with calls, one to one.

    An assistant's turn becomes a call (a note below 200 characters, else an
    answer) that needs the call two turns before it, if there is one there; the
    turn of anyone after it becomes its result.
    """
    call_id = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    chars = F.length("text")
    call = F.struct(
        call_id(F.col("turn")).alias("id"), F.when(chars < 200, "note").otherwise("answer").alias("name"),
        F.to_json(F.struct("text", chars.alias("chars"))).alias("arguments"),
        F.when(F.col("turn") >= 3, F.array(call_id(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"))
    result = F.to_json(F.struct(call_id(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    speaks = F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(speaks, "assistant").otherwise("tool").alias("role"),
        F.when(speaks, F.to_json(F.struct(F.array(call).alias("tool_calls")))).otherwise(result).alias("text"))


#: What the query over ``conversations`` returns, where (conv_id, turn) has one row.
SQL = """
with a as (select conv_id, turn, text, length(text) as chars from conversations where role = 'assistant'),
c as (select a.*, 'call-' || a.conv_id || '-' || a.turn as call_id, case when a.chars < 200 then 'note' else 'answer' end as name,
             case when a.turn >= 3 and b.turn is null then 'unknown call call-' || a.conv_id || '-' || (a.turn - 2) end as lost
      from a left join a b on b.conv_id = a.conv_id and b.turn = a.turn - 2)
select c.conv_id, c.turn, c.call_id, c.name, row_number() over (partition by c.conv_id order by c.turn) - 1 as position,
       concat_ws(';', case when chars < 1 then 'chars: below 1' end, lost) as errors, r.turn as result_turn,
       '{"arguments":{"chars":' || chars || ',"text":' || to_json(c.text)::varchar || '},"id":' || to_json(call_id)::varchar || ',"name":"' || name
       || '","result":' || coalesce(to_json(r.text)::varchar, 'null') || '}' as canonical
from c left join conversations r on r.conv_id = c.conv_id and r.turn = c.turn + 1 and r.role <> 'assistant'
"""
