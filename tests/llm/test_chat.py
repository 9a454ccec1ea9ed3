"""Chat messages whose texts, calls or order once went wrong, and a brute-force version of linking, ordering and validation."""

import json
import random


SCHEMA = "conv_id long, turn long, role string, text string"


def call(i, arguments=None, after=(), name="find"):
    return {"id": i, "name": name, "arguments": {} if arguments is None else arguments, "after": list(after)}


def tagged(c):
    return "<tool_call>" + json.dumps(c) + "</tool_call>"


def test_text_beside_calls_is_kept(spark):
    from corvane.llm.chat import format_chat

    one = lambda i: "<tool_call>" + json.dumps({"id": i, "name": "find"}) + "</tool_call>"
    rows = [(1, 0, "assistant", f"Let me look. {one('a')} and <tool_call>{{broken</tool_call>{one('a')} end"), (1, 1, "assistant", f"{one('a')}{one('b')}"), (2, 0, "assistant", one("a"))]
    got = format_chat(spark.createDataFrame(rows, SCHEMA)).collect()
    content = {(r["conv_id"], r["turn"]): json.loads(r["message"])["content"] for r in got}
    assert content == {(1, 0): f"Let me look.  and <tool_call>{{broken</tool_call>{one('a')} end", (1, 1): one("a"), (2, 0): ""}
    assert all(r["n_calls"] == 1 for r in got)


def test_rows_of_one_turn_keep_their_own(spark):
    """Three rows share conversation and turn; conversations and turns may be null; other columns are left alone."""
    from corvane.llm.chat import format_chat

    rows = [(1, 0, "assistant", "plain words"), (1, 0, "assistant", tagged(call("a"))), (1, 0, "assistant", tagged(call("b", after=["a"]))), (None, None, "assistant", tagged(call("a"))), (None, 3, "tool", json.dumps({"tool_call_id": "a", "content": "x"})), (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": "y"}))]
    frame = spark.createDataFrame([(*r, 5, "z") for r in rows], SCHEMA + ", level int, message string")
    got = format_chat(frame).collect()
    said = sorted((r["conv_id"] or 0, r["turn"] or 0, r["n_calls"], r["level"], json.loads(r["message"])["content"], r["linked"]) for r in got)
    assert said == sorted([(1, 0, 0, 0, "plain words", None), (1, 0, 1, 0, "", None), (1, 0, 1, 1, "", None), (0, 0, 1, 0, "", None), (0, 3, 0, 1, "x", True), (1, 1, 0, 2, "y", True)], key=lambda x: (x[0], x[1], x[2], x[3], x[4], x[5] is not None))


def plain(rows):
    """(conv, turn, row) -> calls as (id, level, valid, answered), and for results (linked, level), one conversation after the other."""
    from corvane.llm.chat import schema_errors

    out = {}
    for conv in {r[0] for r in rows}:
        own = [(k, *r[1:]) for k, r in enumerate(rows) if r[0] == conv]
        tools, calls, answered = {}, {}, set()
        for k, turn, role, text in sorted(own, key=lambda x: (x[1] is not None, x[1] or 0)):
            value = json.loads(text) if text and text.startswith("{") else None
            if role == "system" and value:
                for t in value["tools"]:
                    t = t.get("function", t)
                    tools.setdefault(t["name"], t["parameters"])
            if role == "assistant" and value:
                for c in value["tool_calls"]:
                    calls.setdefault(c["id"], (k, c))
            if role == "tool" and value:
                answered.add(value["tool_call_id"])
        level = {}
        for _ in calls:
            for i, (_, c) in calls.items():
                if i not in level and all(a in level for a in c["after"]):
                    level[i] = max([level[a] + 1 for a in c["after"]], default=0)
        for k, turn, role, text in own:
            mine = [(i, level.get(i), not schema_errors(c["arguments"], tools.get(c["name"], {})), i in answered) for i, (at, c) in calls.items() if at == k]
            value = json.loads(text) if role == "tool" and text.startswith("{") else None
            out[k] = (sorted(mine), (value["tool_call_id"] in calls, level.get(value["tool_call_id"])) if value else None)
    return out


def test_linking_ordering_and_validation(spark):
    """Against the plain version: chains, circles, unknown and repeated identifiers, bad arguments, schemas of the conversation; by groups and by joins."""
    from corvane.llm import chat
    from corvane.runtime import Workspace

    rng = random.Random(5)
    rows = []
    tool = lambda name, kind: {"name": name, "parameters": {"type": "object", "required": ["q"], "properties": {"q": {"type": kind}}, "additionalProperties": False}}
    for conv in [None, 1, 2, 3]:
        rows.append((conv, 0, "system", json.dumps({"tools": [tool("find", "string"), {"type": "function", "function": tool("add", "integer")}, tool("find", "null")]})))
        for turn in range(1, 40):
            calls = [call(f"c{rng.randrange(60)}", {"q": rng.choice(["x", 1, 2.0, None, 1.5])} | ({"z": 1} if rng.random() < 0.1 else {}), [f"c{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 0, 1, 2]))], rng.choice(["find", "add", "other"])) for _ in range(rng.choice([1, 1, 3]))]
            calls = list({c["id"]: c for c in reversed(calls)}.values())
            for c in calls:
                c["after"] = sorted(set(c["after"]))
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            if rng.random() < 0.5:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(60)}", "content": "done"})))
    rows.append((9, 0, "assistant", json.dumps({"tool_calls": [call(f"k{i}", after=[f"k{i - 1}"] if i else []) for i in range(12)]})))
    want = plain(rows)
    frame = spark.createDataFrame([(*r[:3], r[3]) for r in rows], SCHEMA).coalesce(1)
    for r in chat.format_chat(frame).collect():
        places = [k for k, x in enumerate(rows) if x[:3] == (r["conv_id"], r["turn"], r["role"])]
        mine, result = want[places[0]]
        assert len(places) == 1
        message = json.loads(r["message"])
        assert sorted(c["id"] for c in message.get("tool_calls", [])) == [i for i, *_ in mine]
        levels = {i: v for i, v, *_ in mine}
        order = [levels[c["id"]] if levels[c["id"]] is not None else 1 << 30 for c in message.get("tool_calls", [])]
        assert order == sorted(order)
        assert (r["n_calls"], r["n_valid"], r["n_answered"]) == (len(mine), sum(v for _, _, v, _ in mine), sum(a for *_, a in mine))
        if mine:
            assert r["level"] == max((v for _, v, *_ in mine if v is not None), default=0)
        if result:
            assert r["linked"] == result[0] and (r["level"] == result[1] + 1 if result[1] is not None else r["level"] == 0)
    work = Workspace(spark, "test-chat")
    calls = work.write(chat.call_table(work.write(chat.parse_messages(frame), "parsed"), work).select("conv", "call_id"), "named")
    raw = {(str(r[0]) if r[0] is not None else "", c["id"]): c["after"] for r in reversed(rows) if r[2] == "assistant" for c in json.loads(r[3])["tool_calls"]}
    listed = spark.createDataFrame([(*k, v) for k, v in raw.items()], "conv string, call_id string, after array<string>")
    assert calls.count() == len(raw)
    by_group = {(r["conv"], r["call_id"]): r["level"] for r in chat.call_levels(listed, Workspace(spark, "test-chat")).collect()}
    by_joins = {(r["conv"], r["call_id"]): r["level"] for r in chat.call_levels(listed, Workspace(spark, "test-chat"), together=5).collect()}
    assert by_group == by_joins and by_group[("9", "k11")] == 11 and len(by_group) < len(raw)


def test_very_long_and_repeated_messages(spark):
    from corvane.llm.chat import format_chat

    text = "long words " * 200_000
    rows = [(1, 0, "user", text)] * 3 + [(1, 0, None, None), (None, None, "assistant", "{" * 5000), (1, 2, "system", "[" * 5000)]
    got = format_chat(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and sum(json.loads(r["message"])["content"] == text for r in got) == 3 and all(r["n_calls"] == 0 for r in got)


def test_chat(spark):
    from corvane.llm.chat import canonical, format_chat, schema_errors

    schema = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "additionalProperties": False}
    assert schema_errors({"q": "x", "n": 2}, schema) == [] and schema_errors({"n": "2", "z": 1}, schema) != []
    call = lambda i, args, after=(): {"id": i, "name": "find", "arguments": args, "after": list(after)}
    rows = [
        (1, 0, "user", 'hé "q"\n'),
        (1, 1, "assistant", json.dumps({"tool_calls": [call("b", {"q": "y"}, ["a"]), call("a", {"n": 1})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [2]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "nobody", "content": "x"})),
        (1, 4, "assistant", "<tool_call>" + json.dumps(call("c", {"q": ""}, ["c"])) + "</tool_call>"),
        (None, None, None, None),
        (2, 0, "assistant", "{broken"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"find": schema}).collect()}
    m = {k: json.loads(r["message"]) for k, r in got.items()}
    assert all(canonical(m[k]) == r["message"] for k, r in got.items())
    assert [c["id"] for c in m[(1, 1)]["tool_calls"]] == ["a", "b"] and got[(1, 1)]["level"] == 1 and got[(1, 1)]["n_valid"] == 1 and got[(1, 1)]["n_answered"] == 1
    assert got[(1, 2)]["linked"] and got[(1, 2)]["level"] == 2 and m[(1, 2)]["content"] == '{"a":[2],"z":1}'
    assert got[(1, 3)]["linked"] is False and got[(1, 4)]["n_calls"] == 1 and m[(None, None)] == {"content": "", "role": "user"} and m[(2, 0)]["content"] == "{broken"
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_odd_schemas(spark):
    from corvane.llm.chat import same, schema_errors

    assert schema_errors(None, {"type": ["string", "null"]}) == [] and schema_errors(3, {"type": ["string", "null"]}) == ["$: not string or null"]
    assert schema_errors(3, {"type": [["x"], 7]}) == [] and schema_errors(3, {"type": {"a": 1}}) == [] and schema_errors(3, {"type": 5}) == []
    assert schema_errors(10**400, {"type": "integer"}) == [] and schema_errors(2.0, {"type": "integer"}) == [] and schema_errors(float("inf"), {"type": "integer"}) != []
    assert schema_errors({}, {"required": [["q"], {"a": 1}, 3, "z"]}) == ["$.z: missing"]
    assert schema_errors(1, {"enum": [True]}) != [] and schema_errors(True, {"enum": [1]}) != [] and schema_errors(1, {"enum": [1.0]}) == []
    assert schema_errors({"a": [True]}, {"enum": [{"a": [1]}]}) != [] and same({"a": [1, {"b": None}]}, {"a": [1.0, {"b": None}]})
    assert schema_errors({"b": [1, "x", 2], "a": 1, "c": 0}, {"properties": {"b": {"items": {"type": "string"}}, "a": {"type": "string"}}, "additionalProperties": False}) == ["$.b[0]: not string", "$.b[2]: not string", "$.a: not string", "$.c: unknown"]
    deep, value = {"type": "string"}, 1
    for _ in range(5000):
        deep, value = {"properties": {"x": deep}}, {"x": value}
    assert len(schema_errors(value, deep)) == 1


def test_odd_json_of_calls_and_texts(spark):
    from corvane.llm.chat import format_chat

    big = "9" * 400
    nested = "[" * 900 + "]" * 900
    calls = [
        '{"id":"a","name":"find","arguments":{"q":"\\ud800","n":' + big + ',"c":"\\u001f\\u2028"}}',
        '{"id":"\\udc00","name":"find","arguments":{}}',
        '{"id":"b","name":"find","arguments":{"q":1e999},"after":["\\ud800"]}',
        '{"id":"c","name":"find","arguments":{"q":null,"deep":' + nested + "}}",
    ]
    schema = {"type": "object", "required": ["q", ["q"]], "properties": {"q": {"type": ["string", "null"]}, "n": {"type": "integer"}}}
    text = 'a b c\u0085d\x1f\x00\x7f"\\\n\r\t\x0b end \\u001F'
    rows = [(1, 0, "system", json.dumps({"tools": [{"name": "find", "parameters": schema}]})), *((1, i + 1, "assistant", c) for i, c in enumerate(calls)), (1, 8, "tool", '{"tool_call_id":"a","content":"x\\ud800y"}'), (1, 9, "tool", '{"tool_call_id":"\\ud800","content":1}'), (1, 10, "tool", '{"tool_call_id":"c","content":{"\\udfff":[1e999]}}'), (1, 11, "user", text), (1, 12, text, "role")]
    got = {r["turn"]: r for r in format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    said = {t: json.loads(r["message"]) for t, r in got.items()}
    assert [got[t]["n_calls"] for t in (1, 2, 3, 4)] == [1, 0, 1, 1] and [got[t]["n_valid"] for t in (1, 3, 4)] == [1, 0, 1]
    assert said[1]["tool_calls"][0]["arguments"] == {"q": "\ud800", "n": int(big), "c": "\x1f "} and "\\ud800" in got[1]["message"] and "\\u001f" in got[1]["message"]
    assert said[2]["content"] == calls[1] and said[3]["tool_calls"][0]["arguments"] is None
    assert got[8]["linked"] and said[8]["content"] == "x�y" and got[9]["linked"] is None and said[9]["content"] == rows[6][3]
    assert got[10]["linked"] and said[11] == {"content": text, "role": "user"} and said[12]["role"] == text
    assert got[11]["message"] == json.dumps({"content": text, "role": "user"}, separators=(",", ":"), ensure_ascii=False)
