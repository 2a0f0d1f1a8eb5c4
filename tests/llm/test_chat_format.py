import json
import random

import duckdb
import pytest
from plumbline.llm import chat_format as chat
from tests.llm.fixtures import SF

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>, level string, json string"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"


def test_query_equals_sql(spark):
    duckdb.sql(f"create or replace view conversations as select * from '{SF}/conversations.parquet'")
    names = ["conv_id", "turn", "call_id", "level", "status", "n_results", "args_valid", "json"]
    expected = duckdb.sql(f"select {', '.join(names)} from ({chat.OP7_SQL})").fetchall()
    got = [tuple(r[n] for n in names) for r in chat.op7_chat_format(spark, SF).collect()]
    key = lambda r: json.dumps(r)
    assert len(got) == len(expected) and sorted(got, key=key) == sorted(expected, key=key)


def test_links_levels_and_schemas(spark):
    calls = [
        (1, 0, "a", "reply", '{"turn": 1, "text": "x"}', [], "", ""),
        (1, 1, "b", "reply", '{"text":"x","turn":1.5}', ["a", "nobody"], "", ""),
        (1, 2, "c", "reply", "not json", ["b", "a"], "", ""),
        (1, 3, "d", "reply", None, ["e"], "", ""),
        (1, 4, "e", "other", "{}", ["d"], "", ""),
        (1, 5, "f", "reply", '{"text":"é\\n","turn":2,"more":1}', ["d"], "", ""),
        (1, 6, None, "configure", '{"text":""}', ["a"], "", ""),
        (1, 7, "a", "reply", '{"text":"x","turn":NaN}', [], "", ""),
        (None, None, "g", None, "[]", None, "", ""),
    ]
    results = [(1, 9, "a", "late", ""), (1, 3, "a", "first", ""), (1, 3, "zz", "lost", ""), (1, 3, None, "lost too", ""), (1, 4, "b", None, "")]
    rows = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    assert len(rows) == len(calls) + 2
    by = {(r["call_id"], r["turn"]): r for r in rows}
    assert [by[k]["level"] for k in (("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4), ("f", 5), (None, 6), ("a", 7))] == [0, 1, 2, None, None, None, 0, 0]
    assert by["a", 0]["json"] == '{"arguments":{"text":"x","turn":1},"id":"a","level":0,"name":"reply","result":"first","valid":true}'
    assert by["a", 0]["n_results"] == 2 and by["b", 1]["status"] == "linked" and by["c", 2]["status"] == "no_result"
    assert [k for k, r in by.items() if r["args_valid"]] and {k[0] for k, r in by.items() if r["args_valid"]} == {"a", None}
    assert not by["a", 7]["args_valid"] and by["zz", 3]["status"] == "no_call" and by["zz", 3]["args_valid"] is None
    assert "é\\n" in by["f", 5]["json"]
    none = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert chat.link_tool_calls(*none).collect() == []


def test_awkward_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 1, "user", "u2"), (1, 2, "assistant", "0"), (None, None, "user", None), (2, 5, None, "x"), (3, 0, "user", ""), (None, 1, "assistant", None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link_tool_calls(*chat.conversation_calls(messages)).collect()
    assert len(got) == 6
    users = [json.loads(r["json"]) for r in got if r["call_id"] == "1:1"]
    assert [u["result"] for u in users] == ["0", "0"] and [u["level"] for u in users] == [1, 1]


def plain_levels(calls):
    """{(conversation, identifier): level} by walking back from every call; None in or behind a cycle."""
    after: dict = {}
    for conv, _, name, _, _, deps, *_ in calls:
        if conv is not None and name is not None:
            after.setdefault((conv, name), set()).update((conv, d) for d in deps or () if d is not None)

    def level(at, path):
        if at in path:
            return None
        deps = [d for d in after[at] if d in after]
        found = [level(d, path | {at}) for d in deps]
        return 0 if not deps else None if None in found else 1 + max(found)

    return {at: level(at, frozenset()) for at in after}


@pytest.mark.parametrize("most", [50_000, 3])
def test_random_orders(spark, monkeypatch, most):
    """Conversations that share identifiers, with waits in any direction; by one sort, and by rounds of joins."""
    monkeypatch.setattr(chat, "MOST_WAITS", most)
    r = random.Random(11)
    calls = []
    for conv in range(9):
        n = r.randint(1, 9)
        for i in range(n):
            back = conv % 3 == 0  # every third conversation may have cycles
            deps = [f"call_{r.randrange(n + 1 if back else max(1, i))}" for _ in range(r.randint(0, 2))]
            calls.append((conv, i, f"call_{i}", "reply", "{}", [d for d in deps if back or d != f"call_{i}"] + [None][: r.randrange(2)], "", ""))
    calls += [(None, 0, "call_0", "reply", "{}", ["call_1"], "", ""), (1, 50, "call_0", "reply", "{}", None, "", "")]
    results = [(conv, 90, "call_0", f"r{conv}", "") for conv in range(9)] + [(None, 1, "call_0", "lost", "")]
    rows = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    expected = plain_levels(calls)
    assert None in expected.values() and max(x for x in expected.values() if x is not None) >= 2
    linked = [x for x in rows if x["status"] != "no_call"]
    assert len(linked) == len(calls)
    for x in linked:
        assert x["level"] == expected.get((x["conv_id"], x["call_id"]), 0)
        if x["call_id"] == "call_0":
            assert json.loads(x["json"])["result"] == (None if x["conv_id"] is None else f"r{x['conv_id']}") and x["n_results"] == (x["conv_id"] is not None)
    place = [(x["conv_id"] is not None, x["conv_id"] or 0, x["level"] if x["level"] is not None else -1, x["turn"]) for x in linked if x["conv_id"] is not None]
    assert place == sorted(place)


def test_awkward_json(spark):
    args = ['{"text":"x","turn":' + "9" * 400 + "}", '{"text":"\\ud800","turn":1}', '{"text":"x","turn":1e999}', '{"text":"x","turn":' + "9" * 5000 + "}", '{"\\udfff":1}']
    calls = [(1, i, str(i), "reply", a, None, "", "") for i, a in enumerate(args)]
    rows = chat.link_tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS)).orderBy("turn").collect()
    assert [x["args_valid"] for x in rows] == [True, True, False, False, False]
    found = [json.loads(x["json"], parse_constant=lambda _: pytest.fail("not JSON"))["arguments"] for x in rows]
    assert found[0]["turn"] == int("9" * 400) and found[1]["text"] == "\ud800" and found[2] is None and found[3] is None and found[4] == {"\udfff": 1}
    assert "\\ud800" in rows[1]["json"]


def test_other_roles_give_no_row(spark):
    rows = [(1, 0, "tool", "t"), (1, 1, None, "n"), (1, 2, "user", "u"), (1, 3, "assistant", "a")]
    got = chat.link_tool_calls(*chat.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(x["turn"], x["status"]) for x in got] == [(2, "linked")]


def test_booleans_are_no_numbers():
    from plumbline.llm.chat_format import valid

    for value, schema, ok in ((True, {"enum": [1]}, False), (1, {"enum": [True]}, False), (False, {"const": 0}, False), (1.0, {"enum": [1]}, True), (True, {"const": True}, True), ([1, True], {"const": [1, 1]}, False), ({"a": 0}, {"const": {"a": False}}, False), ({"a": [0]}, {"enum": [{"a": [0.0]}]}, True), (None, {"enum": [None]}, True)):
        assert valid(value, schema) is ok, (value, schema)
