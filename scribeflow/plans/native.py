"""``events`` written as native records of every kind, so that the whole parser runs on the driver's tables.

Each event becomes one line of its user's transcript. What kind of record it is follows from the event's type and
the number ``k`` in its props: calls, results, thinking, errors, attachments, tags, telemetry, records to
skip and records of an unknown type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import blocks_text
from ..sources.transcripts import Options, Parsed, dealt, parse

#: Tool names that calls go through in turn; the last ones are no tool's own.
NAMES = {
    "claude-code": ("Read", "Glob", "Grep", "ToolSearch", "Bash", "Edit", "Write", "NotebookEdit", "WebFetch", "WebSearch", "TodoWrite", "mcp__a__b", "Other"),
    "codex": ("exec", "shell", "exec_command", "unified_exec", "apply_patch", "update_plan", "view_image", "read_thread_terminal", "other"),
    "antigravity": ("run_command", "write_to_file", "view_file", "list_dir", "grep_search", "search_web", "read_url_content", "other"),
}
_RESULTS = ("RUN_COMMAND", "VIEW_FILE", "LIST_DIRECTORY", "GREP_SEARCH", "SEARCH_WEB", "READ_URL_CONTENT", "CODE_ACTION")
_SKIPS = ("mode", "permission-mode", "ai-title", "last-prompt", "file-history-snapshot", "file-history-delta", "queue-operation")
#: Seconds of 2026-01-01.
EPOCH = 1_767_225_600
#: Events that a task gets, about: their sorts in ``parse`` hold 5 to 17 KB for each.
TASK_EVENTS = 30_000


def _s(text: Column | str) -> Column:
    """A JSON string; texts here have no other character to escape than quotes."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _n(number: Column) -> Column:
    return number.cast("string")


def _o(**fields: Column) -> Column:
    """A JSON object of JSON texts; fields that are NULL are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def _a(*items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*items)), ","), F.lit("]"))


def _block(kind: str, text: Column) -> Column:
    return _o(type=_s(kind), text=_s(text))


def _pick(names: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), (at % len(names)).cast("int"))


def _say(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def tasks_of(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the table's sessions, by its rows; these are counted in the files' footers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count() // TASK_EVENTS + 1


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    order = Window.partitionBy("session_key").orderBy("ts", "event_id")
    e = dealt(e.select(F.col("user_id").cast("string").alias("session_key"), "ts", "event_id", "k", "props", "event_type"), tasks_of(spark, sf_dir))
    e = e.select("session_key", F.row_number().over(order).alias("n"), "k", "props", F.col("event_type").alias("t"))
    return e.withColumn("r", F.when(F.col("k") % 13 == 5, "skip").when(F.col("k") % 17 == 3, "novel").otherwise(F.col("t")))


def _time(n: Column) -> Column:
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.lit("2026-01-"), part(F.floor(n / 86400) + 1), F.lit("T"), part(F.floor(n % 86400 / 3600)), F.lit(":"), part(F.floor(n % 3600 / 60)), F.lit(":"), part(n % 60), F.lit("Z"))


def _claude(k: Column, n: Column, props: Column, r: Column, at: Column, key: Column) -> Column:
    common = {"uuid": _s(_say("u-", n)), "parentUuid": _s(_say("u-", n - 1)), "timestamp": _s(at), "sessionId": _s(key), "version": _s("2.1.200"), "cwd": _s(F.concat(F.lit("/w/"), key)), "gitBranch": _s("main")}
    image = _o(type=_s("image"), source=F.lit('{"d":1}'))
    yes = F.lit("true")
    said = F.when(k % 3 == 0, _a(_block("text", props), image)).when(k % 3 == 1, _s(props)).otherwise(F.lit("[]"))
    user = _o(type=_s("user"), isMeta=F.when(k % 5 == 0, yes), message=_o(role=_s("user"), content=said), **common)
    usage = _o(input_tokens=_n(k), output_tokens=_n(n), cache_read_input_tokens=F.lit("1"), service_tier=_s("x"))
    think = F.when(k % 2 == 0, _o(type=_s("thinking"), thinking=_s(_say("think ", k)), signature=_s(_say("s", k))))
    call = _o(type=_s("tool_use"), id=_s(_say("c", k)), name=_s(_pick(NAMES["claude-code"], k)), input=props)
    mid, model = _s(_say("m-", F.floor(n / 4).cast("long"))), _s(_say("mo", k % 3))
    click = _o(type=_s("assistant"), message=_o(id=mid, model=model, content=_a(think, call), usage=usage), **common)
    text, fell = F.when(k % 4 != 0, _block("text", _say("bought ", k))), F.when(k % 6 == 0, _o(type=_s("fallback"), to=_s("b")))
    bought = _o(type=_s("assistant"), message=_o(id=mid, model=model, content=_a(text, fell), stop_reason=F.when(k % 2 == 1, _s("end_turn")), usage=F.when(k % 5 != 0, usage)), **common)
    side = F.when(k % 3 == 0, _o(url=_s(_say("http://h/", k)), bytes=_n(k * 10), code=F.lit("200"), durationMs=_n(k))).when(k % 3 == 1, _s("no page"))
    content = F.when(k % 2 == 0, _s(props)).otherwise(_a(_block("text", props), image))
    result = _o(type=_s("tool_result"), tool_use_id=_s(_say("c", k)), content=content)
    view = _o(type=_s("user"), message=_o(content=_a(result, F.when(k % 7 == 0, _block("text", F.lit("note"))))), toolUseResult=side, **common)
    broke = _o(type=_s("assistant"), isApiErrorMessage=yes, message=_o(id=_s("x"), content=_a(_block("text", _say("boom ", k)))), **common)
    failed = _o(type=_s("user"), message=_o(content=_a(_o(type=_s("tool_result"), tool_use_id=_s(_say("c", k)), is_error=yes, content=_s("failed")))), **common)
    attached = _o(type=_s("attachment"), attachment=_o(type=_s("file"), content=_s(_say("att ", k))), **common)
    note = _o(type=_s("system"), subtype=_s("note"), level=_s("warn"), content=_s(_say("sys ", k)), **common)
    error = F.when(k % 4 == 0, broke).when(k % 4 == 1, failed).when(k % 4 == 2, attached).otherwise(note)
    return F.when(r == "skip", _o(type=_s(_pick(_SKIPS, k)))).when(r == "novel", _o(type=_s("novel"), n=_n(k))).when(r == "signup", user).when(r == "click", click).when(r == "purchase", bought).when(r == "view", view).otherwise(error)


def _codex(k: Column, n: Column, props: Column, r: Column, at: Column, key: Column) -> Column:
    def line(kind: str, **payload: Column) -> Column:
        return _o(timestamp=_s(at), type=_s(kind), payload=_o(**payload))

    def item(kind: str, **payload: Column) -> Column:
        return line("response_item", type=_s(kind), **payload)

    ident, name = _s(_say("c", k)), _s(_pick(NAMES["codex"], k))
    words = F.concat(F.when(k % 5 == 0, "<environment_context>").otherwise(""), props)
    said = _a(_block("input_text", words), F.when(k % 3 == 0, _o(type=_s("input_image"), image_url=_s("d"))))
    user = item("message", role=F.when(k % 5 == 1, _s("developer")).otherwise(_s("user")), content=said)
    search = item("web_search_call", id=F.when(k % 8 != 3, _s(_say("w", k))), status=F.when(k % 3 == 0, _s("failed")).otherwise(_s("completed")), action=props)
    click = (
        F.when(k % 4 == 0, item("function_call", call_id=ident, name=name, arguments=_s(props)))
        .when(k % 4 == 1, item("custom_tool_call", call_id=ident, name=name, input=_s(_say("raw ", k))))
        .when(k % 4 == 2, item("local_shell_call", id=ident, action=_o(k=_n(k))))
        .otherwise(search)
    )
    bought = item("message", role=_s("assistant"), content=_a(_block("output_text", _say("bought ", k))))
    tokens = _o(last_token_usage=_o(input_tokens=_n(k), cached_input_tokens=F.lit("1"), output_tokens=F.lit("2")))
    view = F.when(k % 3 == 0, item("function_call_output", call_id=ident, output=_s(props))).when(k % 3 == 1, item("custom_tool_call_output", call_id=ident, output=_o(content=_s(_say("out ", k))))).otherwise(line("event_msg", type=_s("token_count"), info=tokens))
    code = F.concat(F.lit('{"metadata":{"exit_code":'), _n(F.floor(k / 4).cast("long") % 2), F.lit("}}"))
    why = _a(_o(type=_s("summary_text"), text=_s(_say("why ", k))))
    error = (
        F.when(k % 4 == 0, item("function_call_output", call_id=ident, output=_s(code)))
        .when(k % 4 == 1, item("reasoning", summary=why, encrypted_content=_s(_say("s", k))))
        .when(k % 4 == 2, line("turn_context", model=_s(_say("mo", k % 3))))
        .otherwise(line("event_msg", type=_s("error"), message=_s(_say("boom ", k))))
    )
    skip = line("event_msg", type=F.when(k % 2 == 0, _s(_pick(("user_message", "agent_message", "agent_reasoning"), k))).otherwise(_s("x_delta")))
    return F.when(r == "skip", skip).when(r == "novel", line("novel", n=_n(k))).when(r == "signup", user).when(r == "click", click).when(r == "purchase", bought).when(r == "view", view).otherwise(error)


def _antigravity(k: Column, n: Column, props: Column, r: Column, at: Column, key: Column) -> Column:
    def step(kind: Column | str, **more: Column) -> Column:
        return _o(step_index=_n(n - k % 3), source=_s("MODEL"), type=_s(kind), created_at=_s(at), **more)

    ask = F.concat(F.lit("<USER_REQUEST>ask "), _n(k), F.lit("</USER_REQUEST>"))
    chosen = F.concat(F.lit("`Model Selection` from None to M"), _n(k % 4), F.lit(". Done"))
    said = F.when(k % 3 == 0, F.concat(ask, F.lit(" rest "), _n(k))).when(k % 3 == 1, props).otherwise(F.concat(ask, chosen))
    calls = [F.when(k % 3 >= i, _o(name=_s(_pick(NAMES["antigravity"], k + i)), args=props)) for i in range(3)]
    click = step("PLANNER_RESPONSE", thinking=F.when(k % 2 == 1, _s(_say("think ", k))), tool_calls=_a(*calls))
    result = _pick(_RESULTS, k)
    error = (
        F.when(k % 4 == 0, step("GENERIC", content=_s(_say("gen ", k))))
        .when(k % 4 == 1, step("ERROR_MESSAGE", error=_s(_say("boom ", k))))
        .when(k % 4 == 2, step(result, error=_s("bad")))
        .otherwise(step("CHECKPOINT", content=_s(_say("cp ", k))))
    )
    return (
        F.when(r == "skip", step("CONVERSATION_HISTORY"))
        .when(r == "novel", step("NOVEL"))
        .when(r == "signup", step("USER_INPUT", content=_s(said)))
        .when(r == "click", click)
        .when(r == "purchase", step("PLANNER_RESPONSE", content=_s(_say("bought ", k))))
        .when(r == "view", step(result, content=_s(props)))
        .otherwise(error)
    )


def rich_lines(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    """session_key, line, text: each user's events as a transcript of a format."""
    rows = _rows(spark, sf_dir)
    write = {"claude-code": _claude, "codex": _codex, "antigravity": _antigravity}[harness]
    key, n = F.col("session_key"), F.col("n")
    text = write(F.col("k"), n, F.col("props"), F.col("r"), _time(n), key)
    if harness != "codex":
        return rows.select(key, n.alias("line"), text.alias("text"))
    head = _o(timestamp=_s(_time(F.lit(0))), type=_s("session_meta"), payload=_o(id=_s(key), cwd=_s(F.concat(F.lit("/w/"), key)), cli_version=_s("0.144.1"), git=_o(branch=_s("main"))))
    both = F.concat(F.when(n == 1, F.array(F.struct(F.lit(1).alias("line"), head.alias("text")))).otherwise(F.array().cast("array<struct<line:int,text:string>>")), F.array(F.struct((n + 1).alias("line"), text.alias("text"))))
    return rows.select(key, F.explode(both).alias("x")).select("session_key", "x.line", "x.text")


def parsed(spark: SparkSession, sf_dir: str, harness: str, **options) -> Parsed:
    return parse(rich_lines(spark, sf_dir, harness), harness, Options(**({"permissive": True, "tasks": tasks_of(spark, sf_dir)} | options)))


#: Flat columns of an event and their kind in SQL.
FLAT = {
    "id": "VARCHAR", "parent_id": "VARCHAR", "message_id": "VARCHAR", "call_id": "VARCHAR", "name": "VARCHAR", "tool_kind": "VARCHAR", "input": "VARCHAR", "origin": "VARCHAR", "model": "VARCHAR", "stop_reason": "VARCHAR",
    "text": "VARCHAR", "blocks": "VARCHAR", "signature": "VARCHAR", "subtype": "VARCHAR", "level": "VARCHAR", "fetch_url": "VARCHAR", "record_type": "VARCHAR", "is_error": "BOOLEAN",
    "fetch_bytes": "BIGINT", "fetch_status": "BIGINT", "fetch_ms": "BIGINT", "input_tokens": "BIGINT", "output_tokens": "BIGINT", "cache_read": "BIGINT", "cache_new": "BIGINT",
}


def flat(events: DataFrame) -> DataFrame:
    """Every event as a row of plain columns; absent texts are empty."""
    content = F.coalesce("user_message.content", "assistant_message.content", "tool_result.content")
    meta = F.concat_ws("|", "meta.session_id", "meta.cwd", "meta.git_branch", "meta.harness_version", "meta.harness")
    text = F.coalesce(F.nullif(blocks_text(content), F.lit("")), "thinking.text", "system.text", F.when(F.col("meta").isNotNull(), meta))
    usage = "assistant_message.usage."
    values = {
        "id": F.col("id"), "parent_id": F.col("parent_id"), "message_id": F.col("message_id"), "call_id": F.coalesce("tool_call.tool_call_id", "tool_result.tool_call_id"), "name": F.coalesce("tool_call.name", "tool_result.tool_name"),
        "tool_kind": F.col("tool_call.kind"), "input": F.col("tool_call.input"), "origin": F.col("user_message.origin"), "model": F.col("assistant_message.model"), "stop_reason": F.col("assistant_message.stop_reason"), "text": text,
        "blocks": F.array_join(F.transform(content, lambda b: b["kind"]), ","), "signature": F.col("thinking.signature"), "subtype": F.col("system.subtype"), "level": F.col("system.level"), "fetch_url": F.col("tool_result.fetch.url"),
        "record_type": F.col("unknown.record_type"), "is_error": F.coalesce("tool_result.is_error", F.lit(False)), "fetch_bytes": F.col("tool_result.fetch.raw_bytes"), "fetch_status": F.col("tool_result.fetch.status_code").cast("long"), "fetch_ms": F.col("tool_result.fetch.duration_ms"),
        "input_tokens": F.col(usage + "input_tokens"), "output_tokens": F.col(usage + "output_tokens"), "cache_read": F.col(usage + "cache_read_input_tokens"), "cache_new": F.col(usage + "cache_creation_input_tokens"),
    }
    long = lambda c: F.col(c).cast("long").alias(c)
    return events.select("session_key", long("seq"), "kind", "ts_us", long("line"), long("end_line"), *((F.coalesce(v, F.lit("")) if FLAT[c] == "VARCHAR" else v).alias(c) for c, v in values.items()))
