"""Stateless decoding of one native record: what it says, and the events it gives on its own.

Each decoder takes a line's text and returns a dict with ``items`` (events in the record's order) and
control fields for the sequence operators. A record that can't be read has a ``problem``; whether that
ends the transcript or becomes an ``unknown`` event is decided later.
"""

from __future__ import annotations

from ..functions.strict_json import Mismatch, Obj, loads, micros, parsed_elements

#: Record types and tool kinds of each format.
CLAUDE_CONVERSATION = ("user", "assistant", "system", "attachment")
CLAUDE_SKIP = ("mode", "permission-mode", "ai-title", "last-prompt", "file-history-snapshot", "file-history-delta", "queue-operation")
CLAUDE_LEGACY = ("summary",)
CODEX_RECORDS = ("session_meta", "response_item", "event_msg", "turn_context", "world_state", "compacted")
CODEX_SKIP = ("user_message", "agent_message", "agent_reasoning")
CODEX_HARNESS_TAGS = ("<environment_context>", "<ENVIRONMENT_CONTEXT>", "<user_instructions>", "<turn_aborted>")
ANTIGRAVITY_SOURCES = ("USER_EXPLICIT", "MODEL", "SYSTEM")
ANTIGRAVITY_DISPATCH = ("USER_INPUT", "CONVERSATION_HISTORY", "SYSTEM_MESSAGE", "PLANNER_RESPONSE", "CHECKPOINT", "ERROR_MESSAGE")
ANTIGRAVITY_RESULTS = ("RUN_COMMAND", "VIEW_FILE", "LIST_DIRECTORY", "GREP_SEARCH", "SEARCH_WEB", "READ_URL_CONTENT", "CODE_ACTION")
ANTIGRAVITY_AMBIGUOUS = ("GENERIC", "ASK_QUESTION")
TOOL_KINDS = {
    "claude-code": {"Read": "read", "Glob": "search", "Grep": "search", "ToolSearch": "search", "Bash": "execute", "Edit": "edit", "Write": "edit", "NotebookEdit": "edit", "WebFetch": "fetch", "WebSearch": "fetch", "TodoWrite": "think"},
    "codex": {"exec": "execute", "shell": "execute", "local_shell": "execute", "exec_command": "execute", "unified_exec": "execute", "apply_patch": "edit", "update_plan": "think", "web_search": "fetch", "view_image": "read", "read_thread_terminal": "read"},
    "antigravity": {"run_command": "execute", "write_to_file": "edit", "view_file": "read", "list_dir": "read", "grep_search": "search", "search_web": "fetch", "read_url_content": "fetch"},
}


def _kind(harness: str, name: str) -> str:
    return TOOL_KINDS[harness].get(name, "other")


def _blank(x: str | None) -> bool:
    return x is None or x.strip() in ("", "null")


def _n(x):
    """Empty values are absent."""
    return x if x not in ("", 0, False) else None


def _text_block(text: str) -> dict:
    return {"kind": "text", "text": _n(text)}


def _blocks(raw: str | None) -> list[tuple[str, str, Obj | None]]:
    """(type, text, object) of API content: nothing, one string, or an array of typed blocks."""
    if _blank(raw):
        return []
    if raw.lstrip()[0] == '"':
        return [("text", loads(raw), None)]
    out = []
    for e in parsed_elements(raw):
        o = Obj(*e)
        out.append((o.str("type"), o.str("text"), o))
    return out


def _event(kind: str, payload: str, value: dict, rec: dict, **more) -> dict:
    return {"kind": kind, "ts_us": rec["ts_us"], "id": _n(rec.get("uuid", "")), "parent_id": _n(rec.get("parent", "")), payload: value} | more


def _skip(rec: dict, name: str) -> dict:
    return rec | {"skip": name}


# --- records with one JSON object per conversation entry -------------------------------------------


def _claude_block(kind: str, text: str, o: Obj | None) -> dict:
    if kind == "text":
        return _text_block(text)
    return {"kind": kind if kind in ("image", "document") else "other", "raw": o.text if o else None}


def _usage(raw: str | None) -> dict | None:
    if _blank(raw):
        return None
    o = Obj(raw)
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    out = {k: o.int(k) for k in names}
    extra = {k: o.raw(k) for k in o.value if k not in names}
    return out | {"extra": list(extra.items()) or None}


def _fetch(raw: str | None) -> dict | None:
    if _blank(raw) or raw.lstrip()[0] != "{":
        return None
    try:
        o = Obj(raw)
        found = {"url": o.str("url"), "raw_bytes": _n(o.int("bytes")), "status_code": _n(o.int("code")), "duration_ms": _n(o.int("durationMs"))}
    except ValueError:
        return None
    return found if found["url"] else None


def _string_or_empty(raw: str | None) -> str:
    value = loads(raw) if not _blank(raw) else None
    return value if isinstance(value, str) else ""


def claude_code(text: str) -> dict:
    rec: dict = {"items": [], "ts_us": None}
    kind = ""
    items = rec["items"]
    try:
        try:
            o = Obj(text)
            kind = o.str("type")
            rec |= {"ts_us": micros(o.str("timestamp")), "uuid": o.str("uuid"), "parent": o.str("parentUuid")}
            meta = {"harness": "claude-code", "harness_version": _n(o.str("version")), "session_id": _n(o.str("sessionId")), "subagent_id": _n(o.str("agentId")), "is_subagent": _n(o.bool("isSidechain")), "cwd": _n(o.str("cwd")), "git_branch": _n(o.str("gitBranch"))}
            is_meta, subtype, level, api_error = o.bool("isMeta"), o.str("subtype"), o.str("level"), o.bool("isApiErrorMessage")
        except ValueError as e:
            return {"items": [], "ts_us": None, "problem": f"invalid JSON: {e}", "record_type": ""}
        if kind in CLAUDE_SKIP:
            return _skip(rec, kind)
        if kind not in CLAUDE_CONVERSATION:
            return rec | {"problem": f'unrecognized record type "{kind}"', "record_type": kind}
        rec |= {"meta": meta, "version": meta["harness_version"]}
        if kind == "system":
            items.append(_event("system", "system", {"subtype": _n(subtype), "level": _n(level), "text": _n(_string_or_empty(o.raw("content"))), "details": text}, rec))
            return rec
        if kind == "attachment":
            what = "malformed attachment"
            if o.raw("attachment") is None:
                raise Mismatch("attachment record has no attachment")
            a = o.part("attachment")
            items.append(_event("system", "system", {"subtype": "attachment/" + a.str("type"), "text": _n(_string_or_empty(a.raw("content"))), "details": a.text}, rec))
            return rec
        what = f"malformed {kind} message"
        if o.raw("message") is None:
            raise Mismatch(f"{kind} record has no message")
        m = o.part("message")
        mid, model, stop = m.str("id"), m.str("model"), m.str("stop_reason")
        what = f"malformed {kind} content"
        blocks = _blocks(m.raw("content"))
        for _, _, b in blocks:
            if b:
                b.str("thinking"), b.str("signature"), b.str("id"), b.str("name"), b.str("tool_use_id"), b.bool("is_error")
        if kind == "user":
            content = []
            for t, s, b in blocks:
                if t != "tool_result":
                    content.append(_claude_block(t, s, b))
                    continue
                what = "malformed tool_result content"
                result = [_claude_block(*x) for x in _blocks(b.raw("content"))]
                side = o.raw("toolUseResult")
                items.append(_event("tool_result", "tool_result", {"tool_call_id": b.str("tool_use_id"), "is_error": _n(b.bool("is_error")), "content": result, "fetch": _fetch(side), "enrichment": side}, rec))
            if content or not items:
                items.append(_event("user_message", "user_message", {"origin": "harness" if is_meta else "human", "content": content}, rec))
            return rec
        if api_error:
            words = "\n".join(s for t, s, _ in blocks if t == "text" and s)
            items.append(_event("system", "system", {"subtype": "api_error", "level": "error", "text": _n(words), "details": text}, rec))
            return rec
        fold = {"message_id": mid, "model": _n(model), "stop_reason": _n(stop), "usage": None, "content": []}
        rec["fold"] = fold
        what = "malformed usage"
        fold["usage"] = _usage(m.raw("usage"))
        for t, s, b in blocks:
            if t == "thinking":
                items.append(_event("thinking", "thinking", {"text": _n(b.str("thinking")), "signature": _n(b.str("signature"))}, rec, message_id=mid))
            elif t == "text":
                fold["content"].append(_text_block(s))
            elif t == "tool_use":
                items.append(_event("tool_call", "tool_call", {"tool_call_id": b.str("id"), "name": _n(b.str("name")), "kind": _kind("claude-code", b.str("name")), "input": b.raw("input")}, rec, message_id=mid))
            elif t == "fallback":
                items.append(_event("system", "system", {"subtype": "assistant/fallback", "details": b.text}, rec, message_id=mid))
            else:
                return rec | {"problem": f'unrecognized assistant content block "{t}"', "record_type": kind}
        return rec
    except ValueError as e:
        said = str(e)
        return rec | {"problem": said if " has no " in said else f"{what}: {said}", "record_type": kind}


# --- envelope with a typed payload ------------------------------------------------------------------


def _codex_block(kind: str, text: str, o: Obj | None) -> dict:
    if kind in ("text", "input_text", "output_text", "summary_text", "reasoning_text"):
        return _text_block(text)
    return {"kind": "image" if kind in ("input_image", "image") else "other", "raw": o.text if o else None}


def _plain(raw: str | None) -> str:
    try:
        blocks = [_codex_block(*x) for x in _blocks(raw)]
    except ValueError:
        return ""
    return "\n".join(b["text"] for b in blocks if b["kind"] == "text" and b.get("text"))


def _output(raw: str | None) -> list[dict]:
    if _blank(raw):
        return []
    if raw.lstrip()[0] == "{":
        o = Obj(raw)
        said = o.str("content") or o.str("output")
        return [_text_block(said)] if said else [{"kind": "other", "raw": raw}]
    return [_codex_block(*x) for x in _blocks(raw)]


def _failed(item: Obj) -> bool:
    success = item.maybe("success", bool)
    if success is not None:
        return not success
    raw = item.raw("output")
    if _blank(raw):
        return False
    try:
        value = loads(raw)
        value = loads(value) if isinstance(value, str) else value
        code = value["metadata"]["exit_code"]
        return isinstance(code, int) and not isinstance(code, bool) and code != 0
    except (ValueError, KeyError, TypeError):
        return False


def _maybe_json(text: str) -> str | None:
    if not text:
        return None
    try:
        loads(text)
        return text
    except ValueError:
        import json

        return json.dumps(text, ensure_ascii=False)


def codex(text: str, line: int) -> dict:
    rec: dict = {"items": [], "ts_us": None}
    items = rec["items"]
    kind, what = "", "invalid JSON"
    try:
        o = Obj(text)
        kind = o.str("type")
        rec["ts_us"] = micros(o.str("timestamp"))
        payload = o.raw("payload") if not _blank(o.raw("payload")) else None
        if kind not in CODEX_RECORDS:
            return rec | {"problem": f'unrecognized record type "{kind}"', "record_type": kind}
        rec |= {"meta": {"harness": "codex"}, "sparse": kind != "session_meta"}

        def system(subtype: str, level: str = "", said: str = "") -> dict:
            items.append(_event("system", "system", {"subtype": subtype, "level": _n(level), "text": _n(said), "details": o.raw("payload")}, rec))
            return rec

        if kind == "session_meta":
            what = "malformed session_meta"
            p = o.part("payload") if payload else Obj("{}", {})
            rec["meta"] |= {"session_id": _n(p.str("session_id") or p.str("id")), "cwd": _n(p.str("cwd")), "git_branch": _n(p.obj("git").str("branch")), "harness_version": _n(p.str("cli_version"))}
            rec["version"] = rec["meta"]["harness_version"]
            return system("session_meta")
        if kind in ("world_state", "compacted"):
            return system(kind)
        if kind == "turn_context":
            try:
                rec["model"] = _n(Obj(payload or "{}").str("model"))
            except ValueError:
                pass
            return system(kind)
        what = f"malformed {kind}"
        p = o.part("payload") if payload else Obj("{}", {})
        t = p.str("type")
        if kind == "event_msg":
            said = p.str("message")
            info = p.obj("info")
            if t in CODEX_SKIP or t.endswith("_delta"):
                return _skip(rec, f"event_msg/{t}")
            if t == "token_count":
                raw = info.raw("last_token_usage")
                what = "malformed token usage"
                if not _blank(raw):
                    u = Obj(raw)
                    rec["pool"] = {"input_tokens": u.int("input_tokens"), "output_tokens": u.int("output_tokens"), "cache_read_input_tokens": u.int("cached_input_tokens"), "cache_creation_input_tokens": 0}
                return system(t)
            if t in ("task_started", "task_complete"):
                rec["closes"] = True
                return system(t)
            return system(t, "error", said) if t in ("error", "stream_error") else system(t)
        for k in ("role", "encrypted_content", "id", "call_id", "name", "input", "arguments", "status"):
            p.str(k)
        p.maybe("success", bool)
        rec["closes"] = True
        if t == "message":
            what = "malformed message content"
            blocks = _blocks(p.raw("content"))
            content = [_codex_block(*b) for b in blocks]
            role = p.str("role")
            if role == "assistant":
                rec |= {"opens": True, "fold": {"content": content}}
                return rec
            if role == "user":
                ours = bool(blocks) and blocks[0][1].strip().startswith(CODEX_HARNESS_TAGS)
                items.append(_event("user_message", "user_message", {"origin": "harness" if ours else "human", "content": content}, rec))
                return rec
            if role in ("developer", "system"):
                return system(f"message/{role}", "", _plain(p.raw("content")))
            return rec | {"problem": f'unrecognized message role "{role}"', "record_type": kind}
        if t == "reasoning":
            said = _plain(p.raw("content")) or _plain(p.raw("summary"))
            items.append(_event("thinking", "thinking", {"text": _n(said), "signature": _n(p.str("encrypted_content"))}, rec))
            return rec
        call = None
        if t in ("function_call", "custom_tool_call"):
            given = p.str("arguments") if t == "function_call" else p.str("input")
            call = {"tool_call_id": p.str("call_id"), "name": _n(p.str("name")), "kind": _kind("codex", p.str("name")), "input": _maybe_json(given)}
        elif t == "local_shell_call":
            call = {"tool_call_id": p.str("call_id") or p.str("id"), "name": "local_shell", "kind": "execute", "input": p.raw("action")}
        elif t == "web_search_call":
            ident = p.str("id") or f"web_search_call:L{line}"
            call = {"tool_call_id": ident, "name": "web_search", "kind": "fetch", "input": p.raw("action")}
        if call:
            items.append(_event("tool_call", "tool_call", call, rec))
            if t == "web_search_call":
                bad = p.str("status") not in ("", "completed")
                items.append(_event("tool_result", "tool_result", {"tool_call_id": ident, "tool_name": "web_search", "is_error": _n(bad), "content": [], "enrichment": o.raw("payload")}, rec, own_name=True))
            return rec
        if t in ("function_call_output", "custom_tool_call_output"):
            what = "malformed tool output"
            items.append(_event("tool_result", "tool_result", {"tool_call_id": p.str("call_id"), "is_error": _n(_failed(p)), "content": _output(p.raw("output")), "enrichment": o.raw("payload")}, rec))
            return rec
        return rec | {"problem": f'unrecognized response_item type "{t}"', "record_type": kind}
    except ValueError as e:
        return rec | {"problem": f"{what}: {e}", "record_type": "" if what == "invalid JSON" else kind}


# --- numbered steps ---------------------------------------------------------------------------------


def _split_request(text: str) -> tuple[str, str]:
    start, end = text.find("<USER_REQUEST>"), text.find("</USER_REQUEST>")
    if start < 0 or end < start:
        return text.strip(), ""
    return text[start + 14 : end].strip(), (text[:start] + text[end + 15 :]).strip()


def antigravity(text: str) -> dict:
    import re

    rec: dict = {"items": [], "ts_us": None, "meta": {"harness": "antigravity"}, "sparse": True}
    items = rec["items"]
    try:
        o = Obj(text)
        step, kind = o.maybe("step_index", int), o.str("type")
        rec |= {"ts_us": micros(o.str("created_at")), "step": step}
        said, thought, error = o.str("content"), o.str("thinking"), o.str("error")
        o.str("source")
        calls = [Obj(*c) for c in parsed_elements(o.raw("tool_calls"))] if not _blank(o.raw("tool_calls")) else []
        names = [c.str("name") for c in calls]
    except ValueError as e:
        return {"items": [], "ts_us": None, "problem": f"invalid JSON: {e}", "record_type": "", "meta": {"harness": "antigravity"}, "sparse": True}

    def system(subtype: str, level: str = "", words: str = "") -> dict:
        items.append(_event("system", "system", {"subtype": subtype, "level": _n(level), "text": _n(words), "details": text}, rec))
        return rec

    if step is None:
        return rec | {"problem": "record has no step_index", "record_type": kind}
    if kind == "USER_INPUT":
        m = re.search(r"`Model Selection` from .*? to (.+?)\.\s", said)
        rec["model"] = m[1] if m else None
        request, rest = _split_request(said)
        items.append(_event("user_message", "user_message", {"origin": "human", "content": [_text_block(request)]}, rec))
        return system("user_input_context", "", rest) if rest else rec
    if kind == "CONVERSATION_HISTORY":
        return system("conversation_history")
    if kind in ("SYSTEM_MESSAGE", "CHECKPOINT"):
        return system(kind.lower(), "", said)
    if kind == "ERROR_MESSAGE":
        return system("error_message", "error", error or said)
    if kind == "PLANNER_RESPONSE":
        mid = f"step-{step}"
        if thought:
            items.append(_event("thinking", "thinking", {"text": thought}, rec, message_id=mid))
        items.append(_event("assistant_message", "assistant_message", {"content": [_text_block(said)] if said else []}, rec, message_id=mid))
        for i, c in enumerate(calls):
            items.append(_event("tool_call", "tool_call", {"tool_call_id": f"{mid}:call-{i}", "name": _n(names[i]), "kind": _kind("antigravity", names[i]), "input": c.raw("args")}, rec, message_id=mid))
        return rec | {"names": names}
    if kind in ANTIGRAVITY_RESULTS or kind in ANTIGRAVITY_AMBIGUOUS:
        items.append(_event("tool_result", "tool_result", {"is_error": _n(error != ""), "content": [_text_block(said)]}, rec))
        if kind in ANTIGRAVITY_AMBIGUOUS:
            system(kind.lower(), "", said)
        return rec | {"takes": "result" if kind in ANTIGRAVITY_RESULTS else "either"}
    return rec | {"problem": f'unrecognized record type "{kind}"', "record_type": kind}
