"""Order of tool calls against brute force, hostile arguments, and chats told as tool calls."""

import json
import random

import pytest

from levelforge.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_levels(calls):
    """{(conv, call): level or None for calls that can't be ordered}: plain recursion over one conversation at a time."""
    at = {(c, i): (t, n) for c, t, i, n in calls}
    memo = {}

    def level(key, path):
        if key in path:
            return None
        if key not in memo:
            turn, needs = at[key]
            found = 0
            for need in needs:
                other = (key[0], need)
                if other in at:
                    below = level(other, {*path, key})
                    if below is None:
                        found = None
                        break
                    found = max(found, below + (at[other][0] >= turn))
            if found is not None or not path:
                memo[key] = found
            return found
        return memo[key]

    return {k: level(k, frozenset()) for k in at}


def random_calls(seed, conversations=12, most=30):
    rnd = random.Random(seed)
    out = []
    for c in range(conversations):
        n = rnd.randint(1, most)
        for k in range(n):
            near = [max(0, min(n - 1, k + rnd.randint(-6, 2 if c % 2 else -1))) for _ in range(rnd.randint(0, 3))]
            out.append((c if c else None, k // 2, f"c{k}", [f"c{j}" for j in near if j != k or c % 3 == 0] + (["gone"] if k % 7 == 0 else [])))
    return out


@pytest.mark.parametrize("piece", [3, 10_000])
def test_levels(spark, piece):
    calls = random_calls(4)
    df = spark.createDataFrame([(c, t, i, n) for c, t, i, n in calls], "conv_id long, turn long, call_id string, needs array<string>")
    got = {(r.conv_id, r.call_id): None if r.cyclic else r.level for r in chat.levels(df, piece).collect()}
    expected = brute_levels(calls)
    assert got == expected and None in expected.values() and max(x or 0 for x in expected.values()) > 1


def test_a_long_chain_takes_one_round(spark):
    calls = [(1, k, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(3000)] + [(1, 0, "first", ["c2999"])]
    df = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, needs array<string>")
    got = {r.call_id: (r.level, r.cyclic) for r in chat.levels(df).collect()}
    assert got["first"] == (1, False) and got["c2999"] == (0, False)


def test_order_is_topological(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"say {c} {t}") for c in range(5) for t in range(12)] + [(9, 0, "system", "x"), (9, 1, None, None), (None, 2, "user", None)]
    out = chat.link(*chat.messages(chat.as_tool_chats(spark.createDataFrame(rows, SCHEMA))), {"ask": chat.ASK_SCHEMA}).collect()
    place = {(r.conv_id, r.call_id): k for k, r in enumerate(sorted(out, key=lambda r: (r.conv_id is None, r.conv_id, r.level, r.call_turn if r.call_turn is not None else -1, r.call_id)))}
    for c in range(5):
        assert place[c, "call-4"] < place[c, "call-2"] and place[c, "call-4"] < place[c, "call-6"] and place[c, "call-10"] < place[c, "call-8"] and place[c, "call-6"] > place[c, "call-4"]
    linked = [r for r in out if r.conv_id in range(5)]
    assert {r.status for r in linked} == {"linked"} and all(r.errors == [] for r in linked) and {r.level for r in linked} == {0, 1}
    assert json.loads(next(r.message for r in linked if (r.conv_id, r.call_id) == (3, "call-2"))) == {"id": "call-2", "name": "ask", "arguments": {"prompt": "say 3 2", "turn": 2, "role": "user"}, "result": "say 3 3"}


def test_hostile_arguments(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = [deep, '"\\ud800"', '{"\\udfff": 1}', "1" * 6000, "1e999", "NaN", "", "null", '{"a": "\\ud83d\\ude00"}', deep[:1200] + deep[-1200:]]
    said = lambda i, a: json.dumps({"tool_calls": [{"id": str(i), "name": "f", "arguments": a, "depends_on": []}]})
    rows = [(1, i, "assistant", said(i, a)) for i, a in enumerate(texts)] + [(2, 0, "assistant", deep), (2, 1, "assistant", '{"tool_calls": ' + deep), (2, 2, "user", "{")]
    calls, results = chat.messages(spark.createDataFrame(rows, SCHEMA))
    out = {r.call_id: r for r in chat.link(calls, results, {"f": {"type": ["object", "string"], "additionalProperties": False}}).where("conv_id = 1").collect()}
    assert len(out) == len(texts)
    assert out["0"].errors in (["$: too deep"], ["$: not JSON"]) and out["3"].errors == ["$: not JSON"] == out["6"].errors
    assert json.loads(out["1"].message)["arguments"] == "�" and out["2"].errors == ["$.�: additionalProperties"]
    assert json.loads(out["8"].message)["arguments"] == {"a": "\U0001f600"}


def test_a_chain_within_one_turn_takes_few_rounds(spark, monkeypatch):
    """Three thousand calls of one turn, each needing the next, in pieces of fifty links."""
    tables = []
    real = chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda df, *a: tables.append(1) or real(df, *a))
    n = 3000
    rows = [(1, 5, f"c{k}", [f"c{k + 1}"]) for k in range(n)] + [(1, 5, f"c{n}", []), (2, 1, "x", ["y"]), (2, 1, "y", ["x"]), (1, 5, "z", ["z"])]
    got = {(r.conv_id, r.call_id): None if r.cyclic else r.level for r in chat.levels(spark.createDataFrame(rows, "conv_id long, turn long, call_id string, needs array<string>"), 50).collect()}
    assert got == {(1, f"c{k}"): n - k for k in range(n + 1)} | {(2, "x"): None, (2, "y"): None, (1, "z"): None}
    assert len(tables) <= 24
