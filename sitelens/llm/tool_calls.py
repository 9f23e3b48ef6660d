"""Operator 2, chat formatting with linked tool calls.

Messages are rows (conv_id, turn, role, text). An assistant text that is a JSON
object with a list ``tool_calls`` makes calls ({id, name, arguments, after});
a tool text that is a JSON object with ``tool_call_id`` is a result. Spark joins
calls and results on (conv_id, id) by hash, and calls with the calls they depend
on: those named in ``after`` or by {"$ref": id} within the arguments. Arguments
are validated against the schema of the named tool. Every message becomes one
canonical JSON text: keys sorted, no spaces, characters not escaped where JSON
allows it.

Order of calls, topological: [0, turn, place in the message] where no call of the
conversation depends on a later one; else [level, turn, place], the level being
the longest chain below the call, found by peeling all free calls in rounds;
null for calls on or behind a circle.

Defined cases: a null text is null content, anything that isn't such an object
is plain content; of calls that share an id the first (turn, row, place) counts
and the others are ``duplicate``; of results the first counts, others are
``extra``, and ``orphan`` without a call; a call without a result is ``missing``;
a call without a text id or name is ``malformed``; unknown dependencies, unknown
tools, schema violations and what isn't understood of a schema are listed as errors
of the call, however deep; a text nested too deep for the JSON parser is plain
content. A null conv_id or
turn is a value like any other (null turns come first). An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import add_columns, python_ready, stored, table

CALLS = ("array<struct<place:int,id:string,name:string,arguments:string,after:array<string>,errors:array<string>>>")
LINKED = ("array<struct<place:int,id:string,name:string,arguments:string,after:array<string>,errors:array<string>,"
          "status:string,result_turn:bigint,order:array<bigint>>>")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def strict(text: str | None):
    """The JSON object in ``text``; None for anything else, also for repeated
    keys and numbers beyond JSON."""
    def refuse(name):
        raise ValueError(name)

    def once(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def number(digits):
        value = float(digits)
        return value if math.isfinite(value) else refuse(digits)

    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        value = json.loads(text, parse_constant=refuse, parse_float=number, object_pairs_hook=once)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value


def of_type(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, TYPES[kind])


def own_violations(value, schema: dict, at: str) -> tuple[list[str], list[tuple]]:
    """(what of ``value`` itself the schema forbids, what is to be looked at next:
    errors and (value, schema, at) of its parts, in order)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(of_type(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"], []
    out = [] if "enum" not in schema or value in schema["enum"] else [f"{at}: not in enum"]
    size = value if of_type(value, "number") else len(value) if isinstance(value, (str, list)) else None
    for key, wrong in (("minimum", lambda a, b: a < b), ("minLength", lambda a, b: a < b), ("minItems", lambda a, b: a < b),
                       ("maximum", lambda a, b: a > b), ("maxLength", lambda a, b: a > b), ("maxItems", lambda a, b: a > b)):
        fits = of_type(value, "number") if key in ("minimum", "maximum") else isinstance(value, list if "Items" in key else str)
        if key in schema and fits and wrong(size, schema[key]):
            out.append(f"{at}: {key}")
    parts: list[tuple] = []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                parts.append((value[k], known[k], f"{at}.{k}"))
            elif schema.get("additionalProperties") is False:
                parts.append((f"{at}.{k}: not allowed",))
    if isinstance(value, list) and "items" in schema:
        parts += [(item, schema["items"], f"{at}[{i}]") for i, item in enumerate(value)]
    return out, parts


def violations(value, schema: dict) -> list[str]:
    """What of ``value`` the schema forbids: type, enum, bounds, lengths, required,
    properties, additionalProperties, items. A part of the schema that isn't
    understood (an unknown type, a bound that is no number) is an error of its place.
    No recursion: values may be nested to any depth."""
    out, todo = [], [(value, schema, "$")]
    while todo:
        part = todo.pop()
        if len(part) == 1:
            out.append(part[0])
            continue
        try:
            own, parts = own_violations(*part)
        except (TypeError, KeyError, AttributeError):
            own, parts = [f"{part[2]}: schema not understood"], []
        out += own
        todo += reversed(parts)
    return out


def references(value) -> list[str]:
    """Ids in {"$ref": id} objects, in order."""
    out, todo = [], [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            if set(value) == {"$ref"} and isinstance(value["$ref"], str):
                out.append(value["$ref"])
            else:
                todo += [value[k] for k in sorted(value, reverse=True)]
        elif isinstance(value, list):
            todo += reversed(value)
    return out


def read_call(place: int, call, schemas: dict) -> dict:
    call = call if isinstance(call, dict) else {}
    name, arguments = call.get("name"), call.get("arguments", {})
    if isinstance(arguments, str):
        arguments = strict(arguments)
    id_ = call.get("id") if isinstance(call.get("id"), str) else None
    name = name if isinstance(name, str) else None
    errors = ["malformed"] if id_ is None or name is None else []
    after = call.get("after", [])
    after = [a for a in after if isinstance(a, str)] if isinstance(after, list) else []
    if not isinstance(arguments, dict):
        errors.append("$: not a JSON object")
    elif name is not None and name not in schemas:
        errors.append("unknown tool")
    elif name is not None:
        errors += violations(arguments, schemas[name])
    return {"place": place, "id": id_, "name": name, "arguments": canonical(arguments),
            "after": list(dict.fromkeys([*after, *references(arguments)])), "errors": errors}


def read_message(role: str | None, text: str | None, schemas: dict) -> tuple[str | None, list[dict], str | None]:
    """(content, calls, id that it is the result of)."""
    value = strict(text) if role in ("assistant", "tool") else None
    if role == "assistant" and value and isinstance(value.get("tool_calls"), list):
        content = value.get("content")
        content = content if content is None or isinstance(content, str) else canonical(content)
        return content, [read_call(i, c, schemas) for i, c in enumerate(value["tool_calls"])], None
    if role == "tool" and value and isinstance(value.get("tool_call_id"), str):
        content = value.get("content")
        return (content if content is None or isinstance(content, str) else canonical(content)), [], value["tool_call_id"]
    return text, [], None


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, id, level): every call less what is on or behind a circle. Each
    round takes the calls that depend on none of those left."""
    spark, done, level = calls.sparkSession, [], 0
    left, edges = stored(calls, "calls"), stored(edges, "edges")
    while not left.isEmpty():
        busy = edges.select(F.col("conv_id").alias("c"), F.col("id").alias("i")).distinct()
        free = stored(left.join(busy, left.conv_id.eqNullSafe(busy.c) & (left.id == busy.i), "left_anti"), "free")
        if free.isEmpty():
            break
        done.append(free.withColumn("level", F.lit(level)))
        f = free.select(F.col("conv_id").alias("c"), F.col("id").alias("i"))
        edges = stored(edges.join(f, edges.conv_id.eqNullSafe(f.c) & (edges.dep == f.i), "left_anti"), "edges")
        left = stored(left.join(f, left.conv_id.eqNullSafe(f.c) & (left.id == f.i), "left_anti"), "calls")
        level += 1
    out = spark.createDataFrame([], calls.select("conv_id", "id").withColumn("level", F.lit(0)).schema)
    for rows in done:
        out = out.unionByName(rows.select("conv_id", "id", "level"))
    return out


def linked_calls(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with status, result_turn, order and errors; results with status)."""
    calls = read.select("row_id", "conv_id", "turn", F.explode("calls").alias("c")).select("row_id", "conv_id", "turn", "c.*")
    spot = F.struct("turn", "row_id", "place")
    named = calls.where(F.col("id").isNotNull() & F.col("name").isNotNull())
    firsts = named.groupBy("conv_id", "id").agg(F.min(spot).alias("first"))
    results = read.where("result_of is not null").select("row_id", "conv_id", "turn", F.col("result_of").alias("id"))
    answers = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row_id")).alias("answer"))

    def meet(a, b, how="left"):  # hash join on the null-safe key
        b = b.select(*[F.col(x).alias(f"_{x}") if x in ("conv_id", "id") else F.col(x) for x in b.columns])
        return a.join(b, a.conv_id.eqNullSafe(b._conv_id) & (a.id == b._id), how).drop("_conv_id", "_id")

    ids = stored(meet(firsts, answers), "call-ids")
    edges = (meet(named, ids.select("conv_id", "id", "first"), "inner").where(spot == F.col("first"))
             .select("conv_id", "id", "first", F.explode("after").alias("dep")))
    there = ids.select(F.col("conv_id"), F.col("id"), F.col("first").alias("there"))
    edges = stored(meet(edges.select("conv_id", F.col("id").alias("own"), "first", F.col("dep").alias("id")), there)
                   .select("conv_id", F.col("own").alias("id"), F.col("id").alias("dep"), "first", "there"), "edges")
    unknown = edges.where("there is null").groupBy("conv_id", "id").agg(F.sort_array(F.collect_list("dep")).alias("unknown"))
    edges = edges.where("there is not null")
    turned = stored(edges.where(F.col("there") >= F.col("first")).select("conv_id").distinct(), "forward")
    known = ids.select("conv_id", "id", "first", "answer")
    if turned.isEmpty():
        known = known.withColumn("level", F.lit(0))
    else:
        t = turned.select(F.col("conv_id").alias("c"))
        inside = ids.select("conv_id", "id").join(t, ids.conv_id.eqNullSafe(t.c), "left_semi")
        found = levels(inside, edges.select("conv_id", "id", "dep").join(t, edges.conv_id.eqNullSafe(t.c), "left_semi"))
        other = t.withColumn("forward", F.lit(True))
        known = meet(known, found).join(other, known.conv_id.eqNullSafe(other.c), "left").withColumn(
            "level", F.when(F.col("forward").isNull(), F.lit(0)).otherwise(F.col("level"))).drop("c", "forward")
    known = meet(known, unknown)
    out = meet(calls, known)
    is_first = spot == F.col("first")
    status = (F.when(F.col("first").isNull(), "malformed").when(~is_first, "duplicate")
              .when(F.col("answer").isNull(), "missing").otherwise("linked"))
    order = F.when(is_first & F.col("level").isNotNull(),
                   F.array(F.col("level").cast("long"), F.col("turn").cast("long"), F.col("place").cast("long")))
    lost = F.transform(F.coalesce("unknown", F.array().cast("array<string>")), lambda x: F.concat(F.lit("unknown call: "), x))
    out = out.select("row_id", "place", "id", "name", "arguments", "after", F.concat("errors", lost).alias("errors"),
                     status.alias("status"), F.when(is_first, F.col("answer.turn")).alias("result_turn"), order.alias("order"))
    told = meet(results, ids.select("conv_id", "id", "answer", "first"))
    told = told.select("row_id", F.when(F.col("first").isNull(), "orphan").when(
        F.struct("turn", "row_id") == F.col("answer"), "linked").otherwise("extra").alias("result_status"))
    return out, told


def formatted(messages: DataFrame, schemas: dict) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_linked, n_errors, json) of each message."""
    python_ready(messages.sparkSession)

    def read(batch):
        out = [read_message(r, t, schemas) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        content, calls, result = zip(*out, strict=True)
        strings = pa.list_(pa.string())
        kind = pa.struct([("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()),
                          ("after", strings), ("errors", strings)])
        return [pa.array(content, pa.string()), pa.array(calls, pa.list_(kind)), pa.array(result, pa.string())]

    rows = messages.select(F.monotonically_increasing_id().alias("row_id"), "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = stored(add_columns(rows, read, f"content string, calls {CALLS}, result_of string", drop=("text",)), "messages")
    calls, told = linked_calls(rows)
    fields = ("place", "id", "name", "arguments", "after", "errors", "status", "result_turn", "order")
    calls = calls.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(LINKED).alias("linked"))
    rows = rows.drop("calls").join(calls, "row_id", "left").join(told, "row_id", "left")

    def write(batch):
        out = []
        for row in batch.select(["role", "content", "result_of", "result_status", "linked"]).to_pylist():
            message = {"role": row["role"], "content": row["content"]}
            if row["result_of"] is not None:
                message |= {"tool_call_id": row["result_of"], "status": row["result_status"]}
            if row["linked"]:
                message["tool_calls"] = [{k: json.loads(v) if k == "arguments" else v for k, v in c.items() if k != "place"}
                                         for c in row["linked"]]
            out.append(canonical(message))
        return [pa.array(out, pa.string())]

    done = add_columns(rows, write, "json string")
    linked = F.coalesce("linked", F.array().cast(LINKED))
    return done.select(
        "row_id", "conv_id", "turn", "role", F.size(linked).cast("long").alias("n_calls"),
        F.size(F.filter(linked, lambda c: c.status == "linked")).cast("long").alias("n_linked"),
        F.size(F.flatten(F.transform(linked, lambda c: c.errors))).cast("long").alias("n_errors"), "json")


REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {
    "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def as_tool_traffic(conversations: DataFrame) -> DataFrame:
    """The table holds no tool calls, so its turns are read as such: a user turn
    calls the tool ``reply`` with its text, depending on the call of the turn
    two before, and the assistant's turn is the result of the turn before it.
    Other turns stay as they are."""
    turn = F.col("turn").cast("long")
    call = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("call_"), turn).alias("id"), F.lit("reply").alias("name"),
        F.struct(F.col("text").alias("prompt"), turn.alias("turn")).alias("arguments"),
        F.when(turn >= 2, F.array(F.concat(F.lit("call_"), turn - 2))).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(F.lit("call_"), turn - 1).alias("tool_call_id"), F.col("text").alias("content")))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(as_tool_traffic(table(spark, sf_dir, "conversations")), REPLY).drop("row_id")


OP2_SQL = """
WITH c AS (SELECT conv_id, turn, role, text, EXISTS (
             SELECT 1 FROM conversations d WHERE d.conv_id = m.conv_id AND d.role = 'assistant' AND d.turn = m.turn + 1) AS answered,
           EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = m.conv_id AND d.role = 'user' AND d.turn = m.turn - 2) AS known,
           EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = m.conv_id AND d.role = 'user' AND d.turn = m.turn - 1) AS asked
           FROM conversations m),
e AS (SELECT *, role = 'user' AND turn >= 2 AND NOT known AS lost, coalesce(text, '') = '' AS bare FROM c)
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
       CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n_calls,
       CASE WHEN role = 'user' AND answered THEN 1 ELSE 0 END AS n_linked,
       CASE WHEN role = 'user' THEN lost::INT + bare::INT ELSE 0 END AS n_errors,
       CASE role
         WHEN 'user' THEN '{"content":null,"role":"assistant","tool_calls":[{"after":['
           || CASE WHEN turn >= 2 THEN '"call_' || (turn - 2) || '"' ELSE '' END
           || '],"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text) || ',' END || '"turn":' || turn
           || '},"errors":[' || CASE WHEN text IS NULL THEN '"$.prompt: required"' WHEN bare THEN '"$.prompt: minLength"' ELSE '' END
           || CASE WHEN lost AND bare THEN ',' ELSE '' END || CASE WHEN lost THEN '"unknown call: call_' || (turn - 2) || '"' ELSE '' END
           || '],"id":"call_' || turn || '","name":"reply","order":[0,' || turn || ',0],"result_turn":'
           || CASE WHEN answered THEN (turn + 1)::VARCHAR ELSE 'null' END || ',"status":"'
           || CASE WHEN answered THEN 'linked' ELSE 'missing' END || '"}]}'
         WHEN 'assistant' THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"tool","status":"'
           || CASE WHEN asked THEN 'linked' ELSE 'orphan' END || '","tool_call_id":"call_' || (turn - 1) || '"}'
         ELSE '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || to_json(role) || '}' END AS json
FROM e
"""
