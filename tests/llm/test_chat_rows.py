"""Every call and every result of a chat is in one row."""

import json

from levelforge.llm import chat


def test_nothing_vanishes(spark):
    call = lambda i, a="{}": {"id": i, "name": "f", "arguments": a, "depends_on": []}
    said = lambda *c: json.dumps({"tool_calls": list(c)})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [(1, 0, "assistant", said(call("call_0"), call(None))), (1, 1, "tool", result("call_0", "a")), (1, 2, "assistant", said(call("call_0", "[1]"), call("call_0", "[1]"))), (1, 3, "tool", result("call_0", "b"))]
    rows += [(2, 0, "user", f"hot {k}") for k in range(30)] + [(2, 1, "assistant", "same")] * 3 + [(None, 0, "user", "x"), (None, 0, "user", "x"), (3, None, "user", "y"), (3, None, "assistant", "z")]
    calls, results = chat.messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.link(calls, results, {"ask": chat.ASK_SCHEMA}).collect()
    status = lambda c: sorted(r.status for r in out if r.conv_id == c)
    assert status(1) == ["duplicate_call"] * 2 + ["duplicate_result", "linked", "missing_id"]
    assert status(2) == ["duplicate_call"] * 29 + ["duplicate_result"] * 2 + ["linked"]
    assert status(None) == ["duplicate_call", "missing_result"] and status(3) == ["missing_id"] * 2
    with_both = sum(r.status in ("linked", "early_result") for r in out)
    assert len(out) + with_both == calls.count() + results.count()
    assert sum('"hot ' in r.message or "hot " in r.message for r in out) == 30
