import json

import pytest
from pyspark.sql import functions as F

from textbayes.llm import chat, queries


def test_links_order_and_validation(spark):
    call = lambda *c, **k: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c], **k})
    result = lambda i, content: json.dumps({"tool_call_id": i, "content": content})
    rows = [
        (1, 0, "user", "hi \"there\"\n{"), (1, 1, "tool", result("b", "early")), (1, 2, "assistant", call(("a", "search", {"query": "x", "limit": 3}), ("b", "calculator", {"wrong": 1}), content="let me see")),
        (1, 3, "tool", result("a", {"z": 1, "b": [1, 2]})), (1, 4, "tool", result("none", "lost")), (1, 5, "assistant", call(("a", "fetch", {"url": "u", "timeout": "soon"}), (None, "search", {"query": "q", "headers": 1}))),
        (2, 0, "assistant", call(("a", "fetch", {"timeout": 1.5, "url": "http://u", "headers": [{"name": "k", "value": None}]}))), (2, 1, "tool", result("a", "two")), (None, 0, "tool", result("a", "x")), (3, None, None, None), (3, 1, "tool", '{"tool_call'), (3, 1, "tool", '{"tool_call'),
    ]
    df = spark.createDataFrame([(*r, "j") for r in rows], "conv_id long, turn int, role string, text string, json string")
    out = chat.chat_format(df).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert (by[1, 2].n_calls, by[1, 2].n_valid, by[1, 5].n_calls, by[1, 5].n_valid, by[2, 0].n_valid) == (2, 1, 2, 0, 1)
    assert [by[1, t].linked for t in range(5)] == [None, True, None, True, False] and by[2, 1].linked and by[None, 0].linked is None
    assert (by[1, 1].order_turn, by[1, 1].order_step, by[1, 3].order_turn, by[1, 3].order_step) == (2, 1, 3, 0)
    assert [t for (c, t), r in sorted(by.items(), key=lambda x: (x[1].order_turn or 0, x[1].order_step, x[0][1] or 0)) if c == 1] == [0, 2, 1, 3, 4, 5]
    assert by[1, 3].json == '{"content":"{\\"b\\":[1,2],\\"z\\":1}","name":"search","role":"tool","tool_call_id":"a"}'
    assert by[2, 0].json == '{"content":"","role":"assistant","tool_calls":[{"arguments":{"headers":[{"name":"k","value":null}],"timeout":1.5,"url":"http://u"},"id":"a","name":"fetch","valid":true}]}'
    assert by[1, 0].json == json.dumps({"content": "hi \"there\"\n{", "role": "user"}, separators=(",", ":")) and by[3, None].json == '{"content":"","role":""}'
    assert chat.chat_format(df.limit(0)).count() == 0


def test_forms_and_schemas(spark):
    wrap = lambda name, arguments, **k: {"id": "i", "type": "function", "function": {"name": name, "arguments": arguments}, **k}
    cases = [
        (wrap("search", '{"query": "x"}'), True), (wrap("search", {"query": "x"}), True), (wrap("search", '{"query": '), False), (wrap("search", "[]"), False), (wrap("search", None), False), (wrap("none", {}), False), (7, False), (None, False),
        ({"id": 5, "name": "search", "arguments": {"query": ""}}, False), ({"name": "search", "arguments": {"query": "q", "limit": 5}}, False), ({"name": "search", "arguments": {"query": "q", "limit": 4}}, True),
        ({"name": "search", "arguments": {"query": "q", "limit": 1.5}}, False), ({"name": "calculator", "arguments": {"expression": "1", "mode": "exact"}}, True), ({"name": "calculator", "arguments": {"expression": "1", "mode": "Exact"}}, False),
        ({"name": "fetch", "arguments": {"url": "ftp://x"}}, False), ({"name": "fetch", "arguments": {"url": "http://x", "headers": [{"name": "a"}, {"value": "b"}]}}, False), ({"name": "fetch", "arguments": {"url": "http://x", "headers": [{"name": "a", "value": 1}]}}, False),
        ({"name": "fetch", "arguments": {"url": "http://x", "headers": [], "timeout": 3}}, True), ({"name": "fetch", "arguments": {"url": "http://x", "more": 1}}, False),
    ]
    rows = [(1, i, "assistant", json.dumps({"tool_calls": [c, wrap("search", {"query": "good"})]})) for i, (c, _) in enumerate(cases)]
    out = {r.turn: r for r in chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert [out[i].n_valid - 1 for i in range(len(cases))] == [int(ok) for _, ok in cases] and {r.n_calls for r in out.values()} == {2}
    inside = json.loads(out[0].json)["tool_calls"][0]
    assert inside == {"arguments": {"query": "x"}, "id": "i", "name": "search", "valid": True}
    with pytest.raises(ValueError, match="understood"):
        chat.fits(F.col("x"), {"oneOf": []})


def plain(rows):
    """Calls, links and order once more, in Python."""
    calls, out = {}, []
    for conv, turn, role, text in sorted(rows, key=lambda r: r[:2]):
        for c in json.loads(text)["tool_calls"] if role == "assistant" else []:
            if isinstance(c, dict) and "id" in c:
                calls.setdefault((conv, c["id"]), (turn, c.get("function", c)["name"]))
    for conv, turn, role, text in rows:
        if role == "assistant":
            value, listed = json.loads(text), []
            for c in value["tool_calls"]:
                f = c.get("function", c) if isinstance(c, dict) else {}
                a = f.get("arguments", {})
                a = json.loads(a) if isinstance(a, str) else a
                ok = {
                    "search": lambda a: bool(a["query"]) and 1 <= a["limit"] <= 4,  # noqa: B023
                    "calculator": lambda a: a["mode"] in ("exact", "rounded"),
                    "fetch": lambda a: "url" in a and all("name" in h for h in a["headers"]),
                }.get(f.get("name"), lambda a: False)(a)
                listed.append({"arguments": a, "id": c.get("id", "") if isinstance(c, dict) else "", "name": f.get("name", ""), "valid": ok} if f else {"id": "", "name": "", "valid": False})
            said = {"content": value["content"], "role": role, "tool_calls": listed}
            out.append((conv, turn, role, turn, 0, len(listed), sum(c["valid"] for c in listed), None, said))
        elif role == "tool":
            value = json.loads(text)
            first = calls.get((conv, value["tool_call_id"]))
            content = value["content"] if isinstance(value["content"], str) else json.dumps(value["content"], sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            moved = bool(first) and first[0] >= turn
            out.append((conv, turn, role, first[0] if moved else turn, int(moved), 0, 0, bool(first), {"content": content, "name": first[1] if first else "", "role": role, "tool_call_id": value["tool_call_id"]}))
        else:
            out.append((conv, turn, role, turn, 0, 0, 0, None, {"content": text, "role": role}))
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in chat.with_tools(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    got = queries.op10_chat_format(spark, sf).collect()
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(key([*r[:8], json.loads(r.json)]) for r in got) == sorted(key(list(r)) for r in plain(rows))
    assert {(r.n_calls, r.n_valid) for r in got} >= {(1, 0), (1, 1), (2, 1), (0, 0)} and {r.linked for r in got} == {None, True, False} and {r.order_step for r in got} == {0, 1}
