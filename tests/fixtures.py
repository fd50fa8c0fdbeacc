"""Transcripts written for these tests, one in each format, and the kinds of the events they give."""

import json


def jsonl(*records) -> str:
    return "".join((r if isinstance(r, str) else json.dumps(r, separators=(",", ":"))) + "\n" for r in records)


def _cc(kind, n, **more):
    return {"type": kind, "uuid": f"id-{n}", "parentUuid": f"id-{n - 1}", "timestamp": f"2026-03-04T10:00:{n:02d}Z", "sessionId": "count-1", "version": "2.1.190", "cwd": "/srv/count", "gitBranch": "topic"} | more


def _said(mid, *content, tokens=None, **more):
    usage = {"usage": {"input_tokens": tokens[0], "output_tokens": tokens[1], "cache_read_input_tokens": tokens[2], "tier": 7}} if tokens else {}
    return {"message": {"id": mid, "model": f"model-{mid}", "content": list(content)} | usage | more}


def _result(ident, content, **more):
    return {"message": {"content": [{"type": "tool_result", "tool_use_id": ident, "content": content} | more]}}


# Someone asks how many files there are; a search fails and a page is fetched in between.
CLAUDE = jsonl(
    {"type": "permission-mode", "permissionMode": "default"},
    _cc("system", 2, subtype="init", level="info", content="ready"),
    _cc("user", 3, isMeta=True, message={"content": "be brief"}),
    _cc("user", 4, message={"content": [{"type": "text", "text": "How many files?"}, {"type": "document", "source": "d"}]}),
    _cc("assistant", 5, **_said("A", {"type": "text", "text": "Counting."}, tokens=(30, 4, 2))),
    _cc("assistant", 6, **_said("A", {"type": "tool_use", "id": "b1", "name": "Bash", "input": {"cmd": "ls | wc", "n": 1.50}}, tokens=(30, 9, 2))),
    _cc("user", 7, **_result("b1", [{"type": "text", "text": "3"}])),
    _cc("assistant", 8, **_said("B", {"type": "thinking", "thinking": "check", "signature": "k"})),
    _cc("assistant", 9, **_said("B", {"type": "tool_use", "id": "w1", "name": "WebFetch", "input": {}}, {"type": "tool_use", "id": "g1", "name": "Grep", "input": {}}, tokens=(50, 6, 0), stop_reason="tool_use")),
    _cc("user", 11, **_result("g1", "no such path", is_error=True)),
    _cc("user", 14, **_result("w1", "a page"), toolUseResult={"url": "https://files.example/", "bytes": 900, "code": 404, "durationMs": 35}),
    {"type": "queue-operation", "operation": "enqueue"},
    _cc("assistant", 15, **_said("C", {"type": "text", "text": "Three files."}, tokens=(61, 3, 40), stop_reason="end_turn")),
    _cc("attachment", 16, attachment={"type": "listing", "content": "a b c"}),
    _cc("user", 17, **_result("zz", "who asked?")),
    {"type": "last-prompt", "prompt": "How many files?"},
)
CLAUDE_KINDS = "session_meta system user_message user_message tool_call tool_result assistant_message thinking tool_call tool_call tool_result tool_result assistant_message system tool_result assistant_message".split()


def _cx(kind, n, **payload):
    return {"timestamp": f"2026-03-04T11:00:{n:02d}+01:00", "type": kind, "payload": payload}


def _item(kind, n, **payload):
    return _cx("response_item", n, type=kind, **payload)


def _tokens(n, given, cached, made):
    return _cx("event_msg", n, type="token_count", info={"last_token_usage": {"input_tokens": given, "cached_input_tokens": cached, "output_tokens": made}})


# Two answers, each with its own tokens; a search that fails and a patch told of by telemetry.
CODEX = jsonl(
    _cx("session_meta", 0, session_id="sum-9", cwd="/srv/sum", cli_version="0.140.0", git={"branch": "b"}),
    _cx("turn_context", 1, model="model-x"),
    _item("message", 2, role="user", content=[{"type": "input_text", "text": " <user_instructions>short"}]),
    _cx("event_msg", 3, type="agent_reasoning", text="hm"),
    _item("message", 4, role="user", content=[{"type": "input_text", "text": "Add it up"}, {"type": "input_image", "image_url": "i"}]),
    _item("message", 5, role="assistant", content=[{"type": "output_text", "text": "Adding."}]),
    _tokens(6, 70, 10, 5),
    _tokens(7, 80, 20, 6),
    _item("function_call", 8, call_id="f1", name="shell", arguments='{"cmd": ["bc"]}'),
    _item("web_search_call", 9, status="failed", action={"query": "sum"}),
    _item("function_call_output", 10, call_id="f1", output={"output": "55"}, success=True),
    _cx("event_msg", 11, type="patch_apply_end", call_id="p7", changes={"sum.txt": {}}, success=True),
    _item("reasoning", 12, summary=[{"type": "summary_text", "text": "easy"}], encrypted_content="e"),
    _cx("turn_context", 13, model="model-y"),
    _cx("event_msg", 14, type="stream_error", message="again"),
    _item("message", 15, role="assistant", content=[{"type": "output_text", "text": "It is 55."}]),
    _tokens(16, 90, 30, 7),
    _cx("compacted", 17, message="m"),
    _cx("event_msg", 18, type="exec_command_output_delta", chunk="c"),
)
CODEX_KINDS = "session_meta system user_message user_message system system assistant_message tool_call tool_call tool_result tool_result system thinking system system system system assistant_message".split()


def _ag(line, step, kind, **more):
    return {"step_index": step, "source": "MODEL", "type": kind, "created_at": f"2026-03-04T12:00:{line:02d}Z"} | more


# Two calls at once, answered in order; the second question comes with another model; steps out of order.
ANTIGRAVITY = jsonl(
    _ag(1, 2, "PLANNER_RESPONSE", tool_calls=[{"name": "list_dir", "args": {"p": "."}}, {"name": "grep_search", "args": {}}, {"name": "odd"}]),
    _ag(2, 1, "USER_INPUT", content="plain question"),
    _ag(3, 4, "GREP_SEARCH", content="", error="timeout"),
    _ag(4, 3, "LIST_DIRECTORY", content="a\nb"),
    _ag(5, 6, "USER_INPUT", content="before <USER_REQUEST> and now </USER_REQUEST>`Model Selection` from X to Fast Y. Bye"),
    _ag(6, 5, "ERROR_MESSAGE", error="try again"),
    _ag(7, 7, "PLANNER_RESPONSE", thinking="so", content="done"),
    _ag(8, 8, "VIEW_FILE", content="late"),
    _ag(9, 9, "CONVERSATION_HISTORY"),
)
ANTIGRAVITY_KINDS = "session_meta user_message assistant_message tool_call tool_call tool_call tool_result tool_result system user_message system thinking assistant_message tool_result system".split()
