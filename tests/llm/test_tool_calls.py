import json

import pytest

from sitelens.llm import tool_calls as T

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {
    "x": {"type": "integer", "minimum": 1}, "s": {"type": "string", "maxLength": 3, "enum": ["a", "bb"]},
    "l": {"type": "array", "maxItems": 2, "items": {"type": ["number", "null"]}}}}, "g": {}}


def calls(*cs, content=None):
    return json.dumps({"content": content, "tool_calls": list(cs)})


def result(i, content="r"):
    return json.dumps({"content": content, "tool_call_id": i})


def run(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, json string")
    out = T.formatted(df, SCHEMAS).collect()
    assert len(out) == len(rows)
    return out


def told(out):
    """(conv, id) -> (status, order, errors, result turn) of every call."""
    return {(r.conv_id, r.turn, c["id"]): (c["status"], c["order"], c["errors"], c["result_turn"])
            for r in out for c in json.loads(r.json).get("tool_calls", [])}


def test_linking_and_order(spark):
    f = lambda i, **k: {"id": i, "name": "g", "arguments": k.pop("arguments", {}), **k}
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", calls(f("a"), f("b", after=["a"]), content="say")), (1, 2, "tool", result("b")),
        (1, 3, "tool", result("b", "again")), (1, 4, "tool", result("zz")), (1, 5, "assistant", calls(f("a"))),
        # a later call is depended on; a chain, a circle and what is behind it
        (2, 0, "assistant", calls(f("c", after=["b"]), f("b", arguments={"k": [{"$ref": "a"}]}), f("a"))),
        (2, 1, "assistant", calls(f("p", after=["q"]), f("q", after=["p"]), f("r", after=["q"]), f("s", after=["nix"]), f("t", after=["t"]))),
        (2, 2, "tool", result("a")), (None, None, "assistant", calls(f("a"))), (None, None, "tool", result("a")),
        (3, 0, "assistant", calls({"id": 5, "name": "g"}, "x", {"id": "ok", "name": "g"})),
    ]
    out = run(spark, rows)
    got = told(out)
    assert got[1, 1, "a"] == ("missing", [0, 1, 0], [], None)
    assert got[1, 1, "b"] == ("linked", [0, 1, 1], [], 2)
    assert got[1, 5, "a"] == ("duplicate", None, [], None)
    assert [got[2, 0, i][1] for i in "abc"] == [[0, 0, 2], [1, 0, 1], [2, 0, 0]]
    assert [got[2, 1, i][1] for i in "pqrt"] == [None] * 4
    assert got[2, 1, "s"] == ("missing", [0, 1, 3], ["unknown call: nix"], None)
    assert got[None, None, "a"] == ("linked", [0, None, 0], [], None)
    assert [c["status"] for r in out if r.conv_id == 3 for c in json.loads(r.json)["tool_calls"]] == ["malformed", "malformed", "missing"]
    status = {(r.conv_id, r.turn): json.loads(r.json).get("status") for r in out if r.role == "tool"}
    assert status == {(1, 2): "linked", (1, 3): "extra", (1, 4): "orphan", (2, 2): "linked", (None, None): "linked"}
    for r in out:
        value = json.loads(r.json)
        assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.n_calls == len(value.get("tool_calls", []))


def test_repeated_rows_and_plain_texts(spark):
    rows = [(1, 0, "assistant", calls({"id": "a", "name": "g"}))] * 3 + [(1, 1, "tool", result("a"))] * 2
    rows += [(4, i, role, t) for i, (role, t) in enumerate([
        ("user", '{"tool_calls":[]}'), ("assistant", None), ("assistant", ""), ("assistant", "{"), ("assistant", '{"a":1,"a":2}'),
        (None, "é\n \"\\/\x01"), ("tool", "not json"), ("assistant", '{"tool_calls":[{"id":"x","name":"g","arguments":{"n":NaN}}]}'),
        ("assistant", "[" * 100_000), ("assistant", "{" * 100_000), ("tool", '{"tool_call_id":5}'), ("user", "z" * 1_000_000)])]
    out = run(spark, rows)
    assert sorted(json.loads(r.json)["tool_calls"][0]["status"] for r in out if r.conv_id == 1 and r.turn == 0) == [
        "duplicate", "duplicate", "linked"]
    assert sorted(json.loads(r.json)["status"] for r in out if r.conv_id == 1 and r.turn == 1) == ["extra", "linked"]
    for r in out:
        if r.conv_id == 4:
            assert json.loads(r.json) == {"role": r.role, "content": rows[5 + r.turn][3]}


@pytest.mark.parametrize("arguments, want", [
    ({"x": 1}, []), ({"x": 2.0, "s": "bb", "l": [1, None]}, []), ('{"x":3}', []), ("{x}", ["$: not a JSON object"]),
    ({}, ["$.x: required"]), ({"x": 0}, ["$.x: minimum"]), ({"x": "1"}, ["$.x: not integer"]), ({"x": True}, ["$.x: not integer"]),
    ({"x": 1, "y": 1}, ["$.y: not allowed"]), ({"x": 1, "s": "cccc"}, ["$.s: not in enum", "$.s: maxLength"]),
    ({"x": 1, "l": [1, "a", 2]}, ["$.l: maxItems", "$.l[1]: not number or null"]),
])
def test_validation(arguments, want):
    assert T.read_call(0, {"id": "i", "name": "f", "arguments": arguments}, SCHEMAS)["errors"] == want


def test_unknown_tool():
    assert T.read_call(0, {"id": "i", "name": "h"}, SCHEMAS)["errors"] == ["unknown tool"]


def test_empty_table(spark):
    assert T.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), SCHEMAS).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(map(tuple, con.sql(f"SELECT conv_id, turn, role, n_calls, n_linked, n_errors, json FROM ({T.OP2_SQL})").fetchall()))
    got = sorted(map(tuple, T.op2_tool_call_linking(spark, sf).select(
        "conv_id", "turn", "role", "n_calls", "n_linked", "n_errors", "json").collect()))
    assert got == want


def test_deep_arguments_and_odd_schemas(spark):
    deep = {"tool_calls": [{"id": "d", "name": "t", "arguments": {"x": "@"}}, {"id": "e", "name": "odd", "arguments": {"a": 1, "b": "x", "c": [1]}}]}
    texts = [json.dumps(deep).replace('"@"', "[" * n + '{"$ref": "e"}' + "]" * n) for n in (10, 900, 1_500, 20_000, 300_000)]
    schema = {"type": "array"}
    nested = schema
    for _ in range(5):
        nested["items"] = {"type": "array"}
        nested = nested["items"]
    schemas = {"t": {"type": "object", "properties": {"x": schema}},
               "odd": {"type": "object", "properties": {"a": {"type": "any"}, "b": {"minLength": "many"}, "c": {"type": ["date", "array"], "items": 7}}}}
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    got = {r.conv_id: r for r in T.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert len(got) == len(texts)
    for i in (0, 1, 2):
        calls = json.loads(got[i].json)["tool_calls"] if i < 2 else None
        assert got[i].n_calls in (0, 2)
        if calls:
            assert calls[0]["after"] == ["e"]
            assert calls[1]["errors"] == ["$.a: schema not understood", "$.b: schema not understood", "$.c: schema not understood"]
    assert T.references([[{"$ref": "a"}], {"b": {"$ref": "c"}, "a": {"$ref": "b"}}]) == ["a", "b", "c"]
    value = 0
    for _ in range(50_000):
        value = [value]
    assert T.references(value) == [] and T.violations(value, {"type": "array", "items": {"type": "array"}}) == []
