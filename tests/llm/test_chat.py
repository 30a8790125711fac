import json

from tidegate.llm import chat as C

MESSAGES = ("conv_id bigint, turn bigint, kind string, role string, text string, call_id string, name string, arguments string, "
            "needs array<string>, level string, calls string")
TOOLS = [C.Tool("add", (C.Field("a", "integer"), C.Field("b", "number"), C.Field("note", "string", False)))]


def call(conv, turn, call_id, arguments='{"b": 1.5, "a": 2}', needs=None, name="add"):
    return (conv, turn, "call", "assistant", None, call_id, name, arguments, needs, "x", "y")


def result(conv, turn, call_id, text="ok"):
    return (conv, turn, "result", "tool", text, call_id, None, None, None, "x", "y")


def run(spark, rows):
    return {(r.conv_id, r.turn): r for r in C.format_chat(spark.createDataFrame(rows, MESSAGES), TOOLS).collect()}


def test_links_levels_and_status(spark):
    got = run(spark, [
        (1, 0, "message", "user", "hi \"x\"\n", None, None, None, None, "x", "y"),
        call(1, 5, "a"), call(1, 2, "b", needs=["a"]), call(1, 3, "c", needs=["b", "a", "nowhere"]), result(1, 6, "a"),
        result(1, 7, "c"), result(1, 8, "c"), result(1, 9, "z"), result(2, 1, "a"), call(2, 2, "d"), call(2, 3, "d"),
        call(3, 1, "e", needs=["f"]), call(3, 2, "f", needs=["e"]), call(3, 3, "g", needs=["f"]), call(3, 4, "h"),
        call(3, 5, "self", needs=["self"]), call(None, 1, "a"), result(None, 2, "a"), call(4, None, None),
    ])
    status = {k: (r.status, r.level) for k, r in got.items()}
    assert status == {
        (1, 0): ("plain", 0), (1, 5): ("linked", 0), (1, 2): ("pending", 1), (1, 3): ("linked", 2),
        (1, 6): ("linked", 0), (1, 7): ("duplicate", 2), (1, 8): ("duplicate", 2), (1, 9): ("orphan", 0), (2, 1): ("orphan", 0),
        (2, 2): ("duplicate", 0), (2, 3): ("duplicate", 0), (3, 1): ("pending", None), (3, 2): ("pending", None),
        (3, 3): ("pending", None), (3, 4): ("pending", 0), (3, 5): ("pending", None), (None, 1): ("pending", 0),
        (None, 2): ("orphan", 0), (4, None): ("pending", 0),
    }


def test_long_chain(spark):
    got = run(spark, [call(1, k, f"c{k}", needs=[f"c{k - 1}"] if k else None) for k in range(12)])
    assert all(r.level == turn for (_, turn), r in got.items())


def test_arguments_and_canonical_json(spark):
    cases = {
        '{"b": 1.5, "a": 2}': "", '{"a": 2, "b": 3, "note": "x"}': "", '{"a": "2", "b": 3}': "type a", '{"a": 1.5, "b": 3}': "type a",
        '{"b": 1}': "missing a", '{"a": 1, "b": 1, "c": 0}': "unknown c", "[1]": "no object", "bad": "no object", None: "no object",
        '{"a": null, "b": 1}': "type a", '{"note": 1}': "missing a; missing b; type note", "": "no object",
    }
    rows = [call(1, k, f"c{k}", a) for k, a in enumerate(cases)] + [call(1, 99, "n", name="other"), call(1, 98, "m", name=None)]
    got = run(spark, rows)
    for k, (arguments, errors) in enumerate(cases.items()):
        r = got[(1, k)]
        assert r.errors == errors, arguments
        message = json.loads(r.message)
        assert list(message) == sorted(message) and message["call_id"] == f"c{k}"
        try:
            want = json.loads(arguments)
        except (TypeError, ValueError):
            want = arguments
        assert message.get("arguments") == want
    assert got[(1, 99)].errors == got[(1, 98)].errors == "unknown tool"
    assert got[(1, 0)].message == '{"arguments":{"a":2,"b":1.5},"call_id":"c0","name":"add","role":"assistant"}'


def test_hot_conversation_repeats_and_empty(spark):
    rows = [call(1, k, f"c{k}") for k in range(300)] + [result(1, k, f"c{k}") for k in range(300)] + [result(1, 999, "c5")] * 2
    out = C.format_chat(spark.createDataFrame(rows, MESSAGES), TOOLS)
    assert out.count() == len(rows)
    assert C.format_chat(spark.createDataFrame([], MESSAGES), TOOLS).count() == 0
