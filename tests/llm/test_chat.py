import json

import pytest

from aeroledger.llm.chat import link_calls, parse_messages, turns_as_calls

SCHEMAS = {"add": {"x": ("integer", True), "y": ("number", False)}, "say": {"text": ("string", True), "loud": ("boolean", False)}}
TABLE = "conv_id bigint, turn bigint, role string, text string, kind string, valid int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], TABLE)


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="done"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_links_orders_and_serialises(spark):
    rows = [
        (1, 0, "user", "hi {"), (1, 3, "assistant", call(("c1", "add", {"y": 1.5, "x": 2}), ("c2", "say", {"text": "ü\n"}))),
        (1, 1, "tool", result("c1")), (1, 5, "tool", result("c2")), (1, 5, "tool", result("c2")), (2, 0, "tool", result("c1")),
        (1, 6, "assistant", call(("c1", "add", {"x": 9}))), (1, 7, "tool", "{broken"), (3, 0, None, None), (None, None, "user", "x"),
    ]
    found = link_calls(parse_messages(table(spark, rows)), SCHEMAS).collect()
    assert len(found) == len(rows) + 1
    order = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: (r["order_turn"], r["order_step"], r["turn"]))
    steps = [(r["kind"], r["call_id"], r["turn"]) for r in order]
    assert steps.index(("call", "c1", 3)) < steps.index(("result", "c1", 1)) < steps.index(("result", "c2", 5))
    by = {(r["kind"], r["call_id"], r["turn"]): r for r in found if r["conv_id"] == 1}
    first = by["call", "c1", 3]
    assert first["json"] == '{"arguments":{"x":2,"y":1.5},"id":"c1","name":"add","role":"assistant","turn":3,"valid":true}'
    assert json.loads(by["call", "c2", 3]["json"])["arguments"] == {"text": "ü\n"}
    assert by["result", "c1", 1]["call_turn"] == 3
    assert [r["kind"] for r in found if r["conv_id"] == 2] == ["message"]  # the call is in another conversation
    assert [r["json"] for r in found if r["conv_id"] == 3] == ['{"turn":0}']


@pytest.mark.parametrize("name, arguments, good", [
    ("add", {"x": 1}, True), ("add", {"x": 1, "y": 2}, True), ("add", {"x": 1, "y": 2.5}, True), ("add", {"x": "1"}, False),
    ("add", {"x": 1.5}, False), ("add", {"y": 1}, False), ("add", {"x": 1, "z": 1}, False), ("add", {"x": None}, False),
    ("add", [1], False), ("add", 5, False), ("say", {"text": "", "loud": True}, True), ("say", {"text": "a", "loud": 1}, False),
    ("other", {}, False), (None, {"x": 1}, False),
])
def test_arguments_are_validated(spark, name, arguments, good):
    rows = parse_messages(table(spark, [(1, 0, "assistant", call(("c", name, arguments)))]))
    assert [r["valid"] for r in link_calls(rows, SCHEMAS).collect()] == [good]


def test_plain_turns(spark):
    schemas = {"respond": {"text": ("string", True), "turn": ("integer", True)}}
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a" * 200_000), (1, 4, "assistant", ""), (2, 0, "user", None)]
    found = {(r["conv_id"], r["turn"]): r for r in link_calls(turns_as_calls(table(spark, rows)), schemas).collect()}
    assert [found[1, t]["kind"] for t in (0, 1, 2, 4)] == ["message", "call", "result", "message"]
    assert found[1, 2]["call_id"] == "1:1" and found[1, 1]["valid"] and not found[2, 0]["valid"]
    assert link_calls(turns_as_calls(table(spark, [])), schemas).count() == 0
    assert link_calls(parse_messages(table(spark, [])), schemas).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = link_calls(turns_as_calls(table(spark, [(1, 0, "user", "q")])), SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
