"""A scan's vocabulary is spelled for one line of each shape, and its decoded lines are without what it doesn't look at."""

import json

import pytest

from scribeflow.operators import drift
from scribeflow.plans.native import rich_lines
from scribeflow.plans.scratch import written
from scribeflow.sources.transcripts import Options, decoded, parse

SF = "/root/testdata/sf0.001"
TEXTS = [
    *(json.dumps({"type": "assistant", "n": n, "message": {"id": str(n), "content": [{"type": "text", "text": "x" * n}, {"type": "tool_use", "name": f"mcp__{n}"}]}}) for n in range(300)),
    *(json.dumps({"type": "response_item", "payload": {"type": t, "name": n}}) for t in ("a", "b") for n in ("c", "d", None)),
    *('{"type":"t","a.b":{"c":1}}', '{"type":"t","a":{"b.c":1}}', '{"type":"t","a":{"b":{"c":1}}}', '{"type":"t","a":[{"b":1}]}', '{"type":"t","a":{}}', '{"type":"t","a":null}', '{"type":"t"}', "{}"),
    *('{"type":5}', '{"type":""}', "[1]", "7", "null", "no record", "", '{"a":1,"a":2}', '{"tool_calls":[{"name":"a"},{"name":"b"}]}', '{"tool_calls":[{"name":"a,b"}],"source":"s"}', '{"tool_calls":[{"name":"b"},{"name":"a"}],"source":"s"}', None),
]


@pytest.mark.parametrize("harness", ["claude-code", "codex", "antigravity"])
def test_words_are_spelled_once_a_shape(spark, monkeypatch, harness):
    lines = spark.createDataFrame([(f"s{i % 3}", t) for i, t in enumerate(TEXTS)], "session_key string, text string")
    want = {b: {tuple(r) for r in drift.spelled(lines, harness, *b).distinct().collect()} for b in ((), ("session_key",))}
    whole, spelled = drift.spelled, []
    monkeypatch.setattr(drift, "spelled", lambda df, *a: spelled.append(df.count()) or whole(df, *a))
    for b in want:
        rows = drift.vocabulary(lines, harness, *b).drop("harness").collect()
        assert len(rows) == len(want[b]) and {tuple(r) for r in rows} == want[b]
    assert all(n < 30 + 300 * (harness == "claude-code") for n in spelled) and len(spelled) == 2


@pytest.mark.parametrize("harness", ["claude-code", "codex", "antigravity"])
@pytest.mark.parametrize("permissive", [False, True])
def test_spans_say_the_same_of_lines(spark, harness, permissive):
    lines = rich_lines(spark, SF, harness)
    lines = written(lines if permissive else lines.where("lower(text) not like '%novel%' or session_key like '%1'"), "lines")

    def said(spans):
        found = parse(written(decoded(lines, harness, spans=spans), "decoded"), harness, Options(permissive=permissive))
        events = found.events.select("session_key", "seq", "kind", "line", "end_line", "meta.harness_version")
        return [sorted(df.collect(), key=str) for df in (events, found.skips, found.errors)]

    whole, spans = said(False), said(True)
    assert whole == spans and whole[0]
    assert (bool(whole[1]), bool(whole[2])) == (harness != "antigravity", not permissive)
    assert {r.items[0].asDict(True)["assistant_message"] for r in decoded(lines, harness, spans=True).where("size(items) > 0").collect()} == {None}
