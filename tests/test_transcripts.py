import json

import pytest
from fixtures import ANTIGRAVITY, ANTIGRAVITY_KINDS, CLAUDE, CLAUDE_KINDS, CODEX, CODEX_KINDS, jsonl

from scribeflow.operators.promote import promote_patch_apply
from scribeflow.operators.stats import fetch_compression, session_counts, session_stats
from scribeflow.operators.validate import uncovered_lines, violations
from scribeflow.sources.lines import lines_of, raw_lines, read_lines
from scribeflow.sources.transcripts import Options, TranscriptError, parse, parse_one

FORMATS = [("claude-code", CLAUDE, CLAUDE_KINDS), ("codex", CODEX, CODEX_KINDS), ("antigravity", ANTIGRAVITY, ANTIGRAVITY_KINDS)]


def events_of(spark, text, harness, **options):
    return parse_one(lines_of(spark, {"x": text}), harness, Options(**options)).events.orderBy("seq").collect()


@pytest.mark.parametrize("harness,text,kinds", FORMATS)
def test_kinds_and_accounting(spark, harness, text, kinds):
    lines = lines_of(spark, {"x": text})
    found = parse(lines, harness)
    assert [e.kind for e in found.events.orderBy("seq").collect()] == kinds
    assert found.errors.count() == 0
    assert violations(found.events).count() == 0
    assert uncovered_lines(lines, found.events, found.skips).count() == 0


def test_messages_in_parts_are_one(spark):
    found = parse_one(lines_of(spark, {"x": CLAUDE}), "claude-code", Options(keep_raw=True))
    events = found.events.orderBy("seq").collect()
    said = {e.message_id: e for e in events if e.kind == "assistant_message"}
    first = said["A"]
    assert (first.line, first.end_line, len(first.raw), first.assistant_message.model) == (5, 6, 2, "model-A")
    assert [b.text for b in first.assistant_message.content] == ["Counting."]
    assert (first.assistant_message.usage.output_tokens, first.assistant_message.usage.extra) == (9, {"tier": "7"})
    assert said["B"].assistant_message.content == [] and said["B"].assistant_message.stop_reason == "tool_use"
    calls = [e.tool_call for e in events if e.tool_call]
    assert [(c.name, c.kind) for c in calls] == [("Bash", "execute"), ("WebFetch", "fetch"), ("Grep", "search")]
    assert calls[0].input == '{"cmd":"ls | wc","n":1.5}'
    results = {e.tool_result.tool_call_id: e.tool_result for e in events if e.tool_result}
    assert {k: r.tool_name for k, r in results.items()} == {"b1": "Bash", "g1": "Grep", "w1": "WebFetch", "zz": None}
    assert tuple(results["w1"].fetch) == ("https://files.example/", 900, 404, 35) and results["g1"].is_error
    assert [e.user_message.origin for e in events if e.user_message] == ["harness", "human"]
    totals = session_counts(found.events).first()
    assert (totals.input_tokens, totals.output_tokens, totals.cache_read_input_tokens) == (141, 18, 42)
    assert {r.record_type for r in found.skips.collect()} == {"permission-mode", "queue-operation", "last-prompt"}
    assert tuple(fetch_compression(found.events).first())[1:] == (1, 6, 900, 66)


def test_tokens_go_to_the_answer_that_closes_after_them(spark):
    found = parse_one(lines_of(spark, {"x": CODEX}), "codex")
    events = found.events.orderBy("seq").collect()
    one, two = (e.assistant_message for e in events if e.assistant_message)
    assert (one.model, one.usage.input_tokens, one.usage.cache_read_input_tokens, one.usage.output_tokens) == ("model-x", 150, 30, 11)
    assert (two.model, two.usage.input_tokens, two.usage.output_tokens, two.content[0].text) == ("model-y", 90, 7, "It is 55.")
    assert (events[0].meta.session_id, events[0].meta.harness_version, events[0].meta.git_branch) == ("sum-9", "0.140.0", "b")
    assert [e.user_message.origin for e in events if e.user_message] == ["harness", "human"]
    search = [e for e in events if (e.tool_call or e.tool_result) and (e.tool_call or e.tool_result).tool_call_id == "web_search_call:L10"]
    assert [e.kind for e in search] == ["tool_call", "tool_result"] and search[1].tool_result.is_error
    shell = next(e.tool_result for e in events if e.tool_result and e.tool_result.tool_call_id == "f1")
    assert (shell.tool_name, shell.content[0].text, shell.is_error) == ("shell", "55", None)
    assert {r.record_type for r in found.skips.collect()} == {"event_msg/agent_reasoning", "event_msg/exec_command_output_delta"}
    more = promote_patch_apply(found.events).orderBy("seq").collect()
    patch = [e for e in more if (e.tool_call or e.tool_result) and (e.tool_call or e.tool_result).promoted_from]
    assert len(more) == len(events) + 1 and [e.kind for e in patch] == ["tool_call", "tool_result"]
    assert (patch[0].tool_call.name, patch[0].tool_call.input, bool(patch[1].tool_result.is_error)) == ("apply_patch", '{"sum.txt":{}}', False)


def test_results_take_calls_in_order(spark):
    events = events_of(spark, ANTIGRAVITY, "antigravity")
    results = [(e.tool_result.tool_call_id, e.tool_result.tool_name, bool(e.tool_result.is_error)) for e in events if e.tool_result]
    assert results == [("step-2:call-0", "list_dir", False), ("step-2:call-1", "grep_search", True), ("step-8:orphan", None, False)]
    assert [e.line for e in events if e.kind in ("user_message", "assistant_message")] == [2, 1, 5, 7]
    asked = [e.user_message.content[0].text for e in events if e.user_message]
    assert asked == ["plain question", "and now"]
    assert [e.assistant_message.model for e in events if e.assistant_message] == [None, "Fast Y"]
    systems = [(e.system.subtype, e.system.text) for e in events if e.system]
    assert systems == [("error_message", "try again"), ("user_input_context", "before `Model Selection` from X to Fast Y. Bye"), ("conversation_history", None)]
    assert session_counts(parse_one(lines_of(spark, {"x": ANTIGRAVITY}), "antigravity").events).first().input_tokens is None


def test_rows_that_may_be_results(spark):
    step = lambda n, t, **k: {"step_index": n, "source": "MODEL", "type": t, "created_at": ""} | k
    text = jsonl(step(4, "ASK_QUESTION", content="which?"), step(5, "PLANNER_RESPONSE", content="hm", tool_calls=[{"name": "y"}]), step(6, "ASK_QUESTION", content="that"), step(7, "ASK_QUESTION", content="more"))
    events = events_of(spark, text, "antigravity")
    assert [e.kind for e in events] == ["session_meta", "system", "assistant_message", "tool_call", "tool_result", "system"]
    assert (events[1].system.subtype, events[4].tool_result.tool_call_id, events[5].system.text) == ("ask_question", "step-5:call-0", "more")


def test_strict_and_permissive(spark):
    text = jsonl({"type": "user", "message": {"content": "hello"}, "sessionId": "q"}, '["not", "an object"]', {"type": "user"}, {"type": "invented", "z": 1})
    with pytest.raises(TranscriptError, match="line 2: invalid JSON"):
        parse_one(lines_of(spark, {"x": text}), "claude-code")
    events = events_of(spark, text, "claude-code", permissive=True)
    assert [e.kind for e in events] == ["session_meta", "user_message", "unknown", "unknown", "unknown"]
    assert [e.unknown.record_type for e in events[2:]] == [None, "user", "invented"] and events[2].unknown.raw == '["not", "an object"]'


def test_a_new_version_is_hinted_at(spark):
    with pytest.raises(TranscriptError, match="newer than the last validated"):
        parse_one(lines_of(spark, {"x": jsonl({"type": "user", "version": "99.1", "message": {"content": "x"}}, {"type": "who"})}), "claude-code")
    with pytest.raises(TranscriptError, match="codex 98.0: line 1"):
        parse_one(lines_of(spark, {"x": "oops\n"}), "codex", Options(version_hint="98.0"))


def test_resumed_messages_are_always_fatal(spark):
    say = lambda mid: {"type": "assistant", "message": {"id": mid, "content": [{"type": "text", "text": "t"}]}}
    text = jsonl(say("m"), say("m"), say("n"), {"type": "user", "message": {"content": "u"}}, say("m"))
    with pytest.raises(TranscriptError, match="line 5: assistant message m resumed"):
        parse_one(lines_of(spark, {"x": text}), "claude-code", Options(permissive=True))


@pytest.mark.parametrize("harness,text", [f[:2] for f in FORMATS])
def test_line_ends_and_marks_change_nothing(spark, harness, text):
    plain = events_of(spark, text, harness)
    assert events_of(spark, "﻿" + text.replace("\n", "\r\n"), harness) == plain


@pytest.mark.parametrize("harness,text", [f[:2] for f in FORMATS])
def test_numbering_after_decoding_is_the_same(spark, tmp_path, harness, text):
    half = text.splitlines(keepends=True)
    (tmp_path / "a.jsonl").write_text("\ufeff" + "\r\n\n".join(text.splitlines()) + "\n", newline="")
    (tmp_path / "b.jsonl").write_text("".join(half[:3]) + "\ufeff" + "".join(half[3:]), newline="")
    raw, lines = raw_lines(spark, str(tmp_path)), read_lines(spark, str(tmp_path))
    for options in (Options(), Options(permissive=True, keep_raw=True)):
        one, two = parse(raw, harness, options), parse(lines, harness, options)
        for kind in ("events", "skips", "errors"):
            a, b = (sorted(map(str, getattr(x, kind).collect())) for x in (one, two))
            assert a == b, kind
    assert parse(raw, harness).errors.count() == 1
    plan = parse(raw, harness).events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(session_key") == 1 and plan.count("Exchange") == 1


def test_truncation(spark):
    events = events_of(spark, CLAUDE, "claude-code", max_payload_bytes=6)
    results = {e.tool_result.tool_call_id: e.tool_result for e in events if e.tool_result}
    cut, whole = results["g1"].content[0], results["w1"].content[0]
    assert (cut.text, cut.truncated, cut.size) == (None, True, 12) and whole.text == "a page"
    assert json.loads(results["w1"].enrichment).keys() == {"sha256", "size", "truncated"}


def test_statistics(spark):
    row = session_stats(parse_one(lines_of(spark, {"x": CLAUDE}), "claude-code").events).first()
    assert (row.tool_calls, row.unanswered_calls, row.orphan_results, row.tool_errors) == (3, 0, 1, 1)
    assert (row.final_answer, row.wall_time_ms, row.fetch_raw_bytes, row.tool_time_ms) == ("Three files.", 15_000, 900, 1000 + 2000 + 5000)
