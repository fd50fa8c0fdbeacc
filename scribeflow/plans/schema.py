"""The normalized event table: one wide row for each event of a transcript.

``session_key`` names the transcript (its path), ``seq`` the place of an event in it, from 0. Times are UTC
microseconds. Exactly one payload column is set, the one that belongs to ``kind``. A field that a source
leaves empty is NULL. Opaque JSON is kept as its verbatim text. Every leaf says in its metadata which
vocabulary it comes from: ``acp``, ``otel`` or ``ext``.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "0.1.0"

#: Event kinds and the payload column of each.
KINDS = {
    "session_meta": "meta",
    "user_message": "user_message",
    "assistant_message": "assistant_message",
    "thinking": "thinking",
    "tool_call": "tool_call",
    "tool_result": "tool_result",
    "system": "system",
    "unknown": "unknown",
}

#: Tool kinds.
TOOL_KINDS = ("read", "edit", "delete", "move", "search", "execute", "think", "fetch", "switch_mode", "other")

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(_from: str, /, **fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True, {"schema": _from}) for k, v in fields.items()])


BLOCK = _struct("acp", kind=S, text=S, mime_type=S, uri=S, raw=S, truncated=B, size=L, digest=S)
USAGE = _struct("otel", input_tokens=L, output_tokens=L, cache_read_input_tokens=L, cache_creation_input_tokens=L, extra=T.MapType(S, S))
FETCH = _struct("ext", url=S, raw_bytes=L, status_code=I, duration_ms=L)
META = _struct("ext", harness=S, harness_version=S, session_id=S, subagent_id=S, is_subagent=B, cwd=S, git_branch=S)
USER = _struct("acp", origin=S, content=T.ArrayType(BLOCK))
ASSISTANT = _struct("otel", model=S, content=T.ArrayType(BLOCK), stop_reason=S, usage=USAGE)
THINKING = _struct("acp", text=S, signature=S)
CALL = _struct("acp", tool_call_id=S, name=S, kind=S, input=S, promoted_from=S)
RESULT = _struct("acp", tool_call_id=S, tool_name=S, is_error=B, content=T.ArrayType(BLOCK), fetch=FETCH, enrichment=S, promoted_from=S)
SYSTEM = _struct("ext", subtype=S, level=S, text=S, details=S)
UNKNOWN = _struct("ext", record_type=S, reason=S, raw=S)

PAYLOADS = {
    "meta": META,
    "user_message": USER,
    "assistant_message": ASSISTANT,
    "thinking": THINKING,
    "tool_call": CALL,
    "tool_result": RESULT,
    "system": SYSTEM,
    "unknown": UNKNOWN,
}

EVENTS = T.StructType(
    [
        *(T.StructField(k, v, True, {"schema": "ext"}) for k, v in (("session_key", S), ("seq", L), ("kind", S), ("ts_us", L), ("id", S), ("parent_id", S), ("message_id", S), ("line", I), ("end_line", I), ("raw", T.ArrayType(S)))),
        *(T.StructField(k, v, True, {"schema": "ext"}) for k, v in PAYLOADS.items()),
    ]
)
