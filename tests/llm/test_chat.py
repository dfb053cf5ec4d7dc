"""Tool-call linking on hand-written conversations."""

import json

from sparkloom.llm import chat_format

TOOLS = {"get": {"city": ("string", True), "days": ("integer", False), "exact": ("boolean", False)}, "sum": {"of": ("array", True), "scale": ("number", False)}}


def rows(spark, messages):
    conv = spark.createDataFrame([(c, t, r, x if isinstance(x, (str, type(None))) else json.dumps(x), "extra") for c, t, r, x in messages], "conv_id long, turn long, role string, text string, k string")
    calls, results = chat_format.tool_messages(conv)
    got = chat_format.link_tool_calls(calls, results, chat_format.schemas_of(spark, TOOLS))
    return sorted((r.asDict() for r in got.collect()), key=lambda r: (str(r["conv_id"]), r["position"]))


def call(i, name, arguments, needs=()):
    return {"id": i, "name": name, "arguments": arguments, "needs": list(needs)}


def test_linking_order_and_validation(spark):
    got = rows(spark, [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", {"tool_calls": [call("b", "sum", {"scale": 1.5, "of": [1, {"z": 1, "a": 2}]}, ["a"]), call("a", "get", {"city": "Ulm", "days": "3", "who": 1}, [])]}),
        (1, 2, "tool", {"tool_call_id": "a", "content": "sun"}),
        (1, 3, "tool", {"tool_call_id": "x", "content": "lost"}),
        (1, 4, "assistant", "no json {"),
        (2, 0, "assistant", {"tool_calls": [call("p", "get", {"city": "A"}, ["q"]), call("q", "get", {}, ["p"]), call("r", "nope", [1], ["zz"])]}),
        (2, 1, "tool", {"tool_call_id": "p", "content": None}),
        (3, 5, "tool", {"tool_call_id": "s", "content": "early"}),
        (3, 6, "assistant", {"tool_calls": [call("s", "get", {"city": "B"}), call("s", "get", {"city": "C"})]}),
        (3, 7, "tool", {"tool_call_id": "s", "content": "late"}),
        (None, 0, "assistant", {"tool_calls": [call("n", "get", {"city": "D"})]}),
        (4, 0, "tool", None),
    ])
    by = lambda c: [(r["call_id"], r["kind"], r["result_turn"], r["problems"]) for r in got if r["conv_id"] == c]
    assert by(1) == [
        ("a", "call", 2, ["mistyped days", "unknown who"]),
        ("x", "result", 3, ["no call"]),
        ("b", "call", None, ["no result"]),
    ]
    assert by(2) == [
        ("r", "call", None, ["no result", "needs unknown zz", "no schema"]),
        ("p", "call", 1, ["cycle"]),
        ("q", "call", None, ["no result", "cycle", "missing city"]),
    ]
    assert [r[:3] for r in by(3)] == [("s", "call", 5), ("s", "call", 7)] and by(3)[0][3] == ["result before call"] and by(3)[1][3] == []
    assert by(None) == [("n", "call", None, ["no result"])]
    b = next(r for r in got if r["call_id"] == "b")
    assert b["json"] == '{"arguments":{"of":[1,{"a":2,"z":1}],"scale":1.5},"call_id":"b","content":null,"name":"sum","problems":["no result"]}'


def test_long_chain_and_empty(spark):
    chain = [call(f"c{k}", "get", {"city": "x"}, [f"c{k + 1}"] if k < 7 else []) for k in range(8)]
    got = rows(spark, [(1, 0, "assistant", {"tool_calls": chain})])
    assert [r["call_id"] for r in got] == [f"c{k}" for k in range(7, -1, -1)]
    assert rows(spark, []) == []


def test_every_message_is_there(spark):
    messages = [
        (1, 0, "system", "be brief"),
        (1, 1, "user", "weather?"),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("1:1", "get", {"city": "Ulm"})]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "1:1", "content": "sun"})),
        (1, 4, "tool", "no json {"),
        (1, 5, "developer", "x"),
        (1, 6, None, None),
        (2, 0, "system", "alone"),
        (None, 0, "system", "no conversation"),
    ]
    conv = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    schemas = chat_format.schemas_of(spark, TOOLS | {"reply": {"prompt": ("string", True), "turn": ("integer", True)}})
    got = sorted(chat_format.chat_messages(conv, schemas).collect(), key=lambda r: (str(r.conv_id), r.position))
    assert [(r.conv_id, r.position, r.turn, r.kind, r.role, r.call_id, r.result_turn, r.problems) for r in got] == [
        (1, 1, 0, "message", "system", None, None, []),
        (1, 2, 1, "call", None, "exchange:1:1", 2, []),
        (1, 3, 2, "call", None, "tool:1:1", 3, []),
        (1, 4, 4, "message", "tool", None, None, []),
        (1, 5, 5, "message", "developer", None, None, []),
        (1, 6, 6, "message", None, None, None, []),
        (2, 1, 0, "message", "system", None, None, []),
        (None, 1, 0, "message", "system", None, None, []),
    ]
    assert [r.json for r in got if r.kind == "message"][:4] == ['{"content":"be brief","role":"system"}', '{"content":"no json {","role":"tool"}', '{"content":"x","role":"developer"}', '{"content":null,"role":null}']
    assert json.loads(got[2].json)["content"] == "sun"


def test_registered_query_has_every_message(spark, tmp_path):
    from sparkloom.llm.queries import QUERIES

    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "tool", "t"), (1, 4, None, "n")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op1_chat_format"](spark, str(tmp_path)).collect()
    assert sorted(t for r in got for t in (r.turn, r.result_turn) if t is not None) == [0, 1, 2, 3, 4]


def test_null_turns(spark):
    schemas = chat_format.schemas_of(spark, TOOLS)
    calls = [(1, 2, "b", "get", '{"city":"x"}', ["a"]), (1, None, "a", "get", '{"city":"x"}', None), (1, None, "c", "get", '{"city":"x"}', ["b"]), (1, None, "d", "get", '{"city":"x"}', ["c", "zz"])]
    c = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame([(1, None, "a", "ok")], "conv_id long, turn long, call_id string, content string")
    got = sorted(chat_format.link_tool_calls(c, r, schemas).collect(), key=lambda x: x.position)
    assert [(x.call_id, x.problems) for x in got] == [("a", []), ("b", ["no result"]), ("c", ["no result"]), ("d", ["no result", "needs unknown zz"])]


def test_calls_and_results_meet_in_a_hash_join(spark):
    c = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    r = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    plan = chat_format._linked(c, r, chat_format.schemas_of(spark, TOOLS))._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [conv_id" in plan and "FullOuter" in plan


def test_positions_of_a_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(400)] + [(None, t % 7, "system", "s") for t in range(50)] + [(k, 0, "user", "x") for k in range(2, 30)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat_format.chat_messages(conv, chat_format.schemas_of(spark, {"reply": {"prompt": ("string", True)}})).collect()
    for c in {r.conv_id for r in got}:
        mine = sorted((r for r in got if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [r.turn for r in mine] == sorted(r.turn for r in mine)
