"""Queries over native records and over files named by the tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LAST_VALIDATED, foreign_cwd, parse_time, safe_session_id, tail, version_newer
from ..operators import acp, baselines, drift, probes, promote, sinks, stats, validate
from ..sources import discover
from ..sources.detect import detect
from ..sources.lines import numbered
from ..sources.registry import parse_with
from ..sources.transcripts import Options, decoded, parse
from .bridge import event_sessions
from .native import flat, parsed, rich_lines, tasks_of
from .native_sql import WITH, X
from .scratch import written

Query = Callable[[SparkSession, str], DataFrame]
HARNESSES = ("antigravity", "claude-code", "codex")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, sql
        return fn

    return keep


def _all(one: Callable[[str], DataFrame]) -> DataFrame:
    out = None
    for h in HARNESSES:
        part = one(h).withColumn("harness", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


for _h, _name in (("claude-code", "claude"), ("codex", "codex"), ("antigravity", "antigravity")):
    QUERIES[f"parse_events_{_name}"] = lambda spark, d, h=_h: flat(parsed(spark, d, h).events)
    ORACLES[f"parse_events_{_name}"] = f"WITH {WITH[_h]} SELECT * FROM flat"


@query(f"""WITH {X} SELECT 'claude-code' AS harness, session_key, ['mode', 'permission-mode', 'ai-title', 'last-prompt', 'file-history-snapshot', 'file-history-delta', 'queue-operation'][k % 7 + 1] AS record_type, count(*) AS n FROM x WHERE r = 'skip' GROUP BY ALL
  UNION ALL SELECT 'codex', session_key, 'event_msg/' || CASE WHEN k % 2 = 0 THEN ['user_message', 'agent_message', 'agent_reasoning'][k % 3 + 1] ELSE 'x_delta' END, count(*) FROM x WHERE r = 'skip' GROUP BY ALL""")
def parse_skips(spark, d):
    return _all(lambda h: parsed(spark, d, h).skips.groupBy("session_key", "record_type").agg(F.count("*").alias("n")))


@query(f"""WITH {X}, b AS (SELECT session_key, min(n) AS n FROM x WHERE r = 'novel' GROUP BY session_key)
  SELECT 'claude-code' AS harness, session_key, n AS line, 'unrecognized record type "novel"' AS reason, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.session_key = b.session_key AND x.n < b.n AND r <> 'skip') THEN '2.1.200' END AS version, false AS newer FROM b
  UNION ALL SELECT 'codex', session_key, n + 1, 'unrecognized record type "novel"', '0.144.1', false FROM b UNION ALL SELECT 'antigravity', session_key, n, 'unrecognized record type "NOVEL"', NULL, false FROM b""")
def parse_errors(spark, d):
    """Strict reading: the first record of an unknown type ends a transcript."""
    return _all(lambda h: parsed(spark, d, h, permissive=False).errors.select("session_key", F.col("line").cast("long").alias("line"), "reason", "version", "newer"))


@query(f"""WITH {X}, ok AS (SELECT session_key, count(*) AS n FROM x GROUP BY session_key)
  SELECT h.harness, session_key, n + CASE WHEN h.harness = 'codex' THEN 1 ELSE 0 END AS lines, 0::BIGINT AS lost FROM ok, (SELECT unnest(['antigravity', 'claude-code', 'codex']) AS harness) h""")
def parse_accounts_for_all_lines(spark, d):
    def one(h: str) -> DataFrame:
        lines = written(decoded(rich_lines(spark, d, h), h), "decoded")
        found = parse(lines, h, Options(permissive=True, tasks=tasks_of(spark, d)))
        lost = validate.uncovered_lines(lines, found.events, found.skips).groupBy("session_key").agg(F.count("*").alias("lost"))
        good = lines.join(found.errors.select("session_key"), "session_key", "left_anti").groupBy("session_key").agg(F.count("*").alias("lines"))
        return good.join(lost, "session_key", "left").select("session_key", "lines", F.coalesce("lost", F.lit(0)).alias("lost"))

    return _all(one)


@query(f"""WITH {WITH["claude-code"]} SELECT session_key, count(*) FILTER (WHERE kind = 'tool_call') AS tool_calls, count(*) FILTER (WHERE kind = 'tool_result' AND is_error) AS tool_errors,
  coalesce(sum(fetch_bytes), 0)::BIGINT AS fetch_raw_bytes, coalesce(sum(strlen(text) + CASE WHEN blocks LIKE '%image%' THEN 33 ELSE 0 END) FILTER (WHERE kind = 'tool_result'), 0)::BIGINT AS result_bytes FROM flat GROUP BY session_key HAVING count(*) FILTER (WHERE kind IN ('tool_call', 'tool_result')) > 0""")
def native_tool_totals(spark, d):
    return stats.tool_totals(parsed(spark, d, "claude-code").events).select("session_key", "tool_calls", "tool_errors", "fetch_raw_bytes", "result_bytes")


@query(f"""WITH {WITH["claude-code"]} SELECT session_key, count(*) AS fetches, sum(strlen(text) + CASE WHEN blocks LIKE '%image%' THEN 33 ELSE 0 END)::BIGINT AS content_bytes, sum(coalesce(fetch_bytes, 0))::BIGINT AS raw_bytes,
  CASE WHEN sum(coalesce(fetch_bytes, 0)) > 0 THEN (sum(strlen(text) + CASE WHEN blocks LIKE '%image%' THEN 33 ELSE 0 END) * 10000 // sum(coalesce(fetch_bytes, 0)))::BIGINT END AS per_myriad FROM flat WHERE fetch_url <> '' GROUP BY session_key""")
def native_fetch_compression(spark, d):
    return stats.fetch_compression(parsed(spark, d, "claude-code").events)


_KINDS = " UNION ALL ".join(f"SELECT '{h}' AS harness, * FROM (WITH {WITH[h]} SELECT tool_kind AS key, count(*) AS n FROM flat WHERE kind = 'tool_call' GROUP BY tool_kind)" for h in HARNESSES)


@query(_KINDS)
def native_tool_kinds(spark, d):
    """Calls by kind, from each format's own tool names."""
    return _all(lambda h: parsed(spark, d, h).events.where("kind = 'tool_call'").groupBy(F.col("tool_call.kind").alias("key")).agg(F.count("*").alias("n")))


@query(f"""WITH {WITH["codex"]} SELECT session_key, seq, CASE kind WHEN 'user_message' THEN 'user_message_chunk' WHEN 'assistant_message' THEN 'agent_message_chunk' WHEN 'thinking' THEN 'agent_thought_chunk' WHEN 'tool_call' THEN 'tool_call' ELSE 'tool_call_update' END AS update,
  CASE WHEN kind = 'tool_call' THEN '' ELSE text END AS text, call_id AS tool_call_id, CASE WHEN kind = 'tool_call' THEN 'pending' WHEN kind = 'tool_result' AND is_error THEN 'failed' WHEN kind = 'tool_result' THEN 'completed' ELSE '' END AS status, input AS raw_input
  FROM flat WHERE kind IN ('tool_call', 'tool_result') OR kind IN ('user_message', 'assistant_message', 'thinking') AND text <> ''""")
def native_acp_updates(spark, d):
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return acp.acp_updates(parsed(spark, d, "codex").events).select("session_key", "seq", "update", *map(empty, ("text", "tool_call_id", "status", "raw_input")))


@query(f"""WITH {WITH["claude-code"]}, lost AS (
  SELECT 'dropped_events' AS loss_type, CASE WHEN kind = 'system' THEN 'system/' || subtype WHEN kind IN ('session_meta', 'unknown') THEN kind WHEN kind IN ('user_message', 'assistant_message', 'thinking') AND text = '' THEN kind || '_empty' END AS key FROM flat
  UNION ALL SELECT 'dropped_fields', CASE WHEN ts_us IS NOT NULL THEN 'timestamp' END FROM flat UNION ALL SELECT 'dropped_fields', CASE WHEN origin = 'harness' THEN 'user_message.origin' END FROM flat
  UNION ALL SELECT 'dropped_fields', CASE WHEN model <> '' THEN 'assistant_message.model' END FROM flat UNION ALL SELECT 'dropped_fields', CASE WHEN stop_reason <> '' THEN 'assistant_message.stop_reason' END FROM flat
  UNION ALL SELECT 'dropped_fields', CASE WHEN input_tokens IS NOT NULL THEN 'assistant_message.usage' END FROM flat UNION ALL SELECT 'dropped_fields', CASE WHEN signature <> '' THEN 'thinking.signature' END FROM flat
  UNION ALL SELECT 'dropped_fields', CASE WHEN fetch_url <> '' THEN 'tool_result.fetch' END FROM flat UNION ALL SELECT 'dropped_fields', CASE WHEN blocks LIKE '%image%' THEN 'content_block:image' END FROM flat)
  SELECT loss_type, key, count(*) AS value FROM lost WHERE key IS NOT NULL GROUP BY ALL""")
def native_acp_loss(spark, d):
    loss = acp.acp_loss(parsed(spark, d, "claude-code").events).where("loss_type <> 'totals'")
    return loss.groupBy("loss_type", "key").agg(F.sum("value").alias("value"))


@query(f"""WITH {WITH["claude-code"]} SELECT session_key, count(*) FILTER (WHERE strlen(text) > 8) AS cut_texts, count(*) FILTER (WHERE blocks LIKE '%image%') AS cut_images FROM flat WHERE kind = 'tool_result' GROUP BY session_key""")
def native_truncation(spark, d):
    """Results whose text is over 8 bytes keep its size and digest only; so do their images."""
    e = parsed(spark, d, "claude-code", max_payload_bytes=8).events.where("kind = 'tool_result'")
    cut = lambda kind: F.size(F.filter("tool_result.content", lambda b: (b["kind"] == kind) & b["truncated"] & b["text"].isNull() & b["raw"].isNull() & (F.length(b["digest"]) == 64))).cast("long")
    return e.select("session_key", cut("text").alias("t"), cut("image").alias("i")).groupBy("session_key").agg(F.sum("t").alias("cut_texts"), F.sum("i").alias("cut_images"))


@query(f"WITH {WITH['claude-code']} SELECT session_key, max(end_line - line) AS longest, count(*) FILTER (WHERE end_line > line) AS folded FROM flat WHERE kind = 'assistant_message' GROUP BY session_key")
def native_keep_raw(spark, d):
    """Folded messages keep every line they came from; the lines between them are not theirs."""
    e = parsed(spark, d, "claude-code", keep_raw=True).events.where("kind = 'assistant_message'")
    ok = F.forall("raw", lambda t: t.contains('"type":"assistant"')) & (F.size("raw") <= F.col("end_line") - F.col("line") + 1)
    e = e.withColumn("span", F.when(ok, (F.col("end_line") - F.col("line")).cast("long")))
    return e.groupBy("session_key").agg(F.max("span").alias("longest"), F.count_if(F.col("span") > 0).alias("folded"))


@query(f"WITH {WITH['codex']} SELECT kind, count(*) AS n FROM flat WHERE kind <> 'system' GROUP BY kind")
def native_transforms(spark, d):
    """Through the adapter registry, with a transform over the event table."""
    found = parse_with(rich_lines(spark, d, "codex"), "codex", Options(permissive=True, tasks=tasks_of(spark, d)), promote.resolve(["codex:web-search"], "codex")[0], lambda e: e.where("kind <> 'system'"))
    return found.events.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {WITH['codex']} SELECT session_key, seq, kind, call_id, text FROM flat")
def sink_events_jsonl(spark, d):
    """Events as JSON lines, read back."""
    rows = sinks.events_jsonl(parsed(spark, d, "codex").events)
    at = lambda p: F.coalesce(F.get_json_object("value", p), F.lit(""))
    blocks = F.from_json(F.coalesce(*(F.get_json_object("value", f"$.{k}.content") for k in ("user_message", "assistant_message", "tool_result"))), "array<struct<kind:string,text:string>>")
    said = F.array_join(F.transform(F.filter(blocks, lambda b: (b["kind"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    m = F.get_json_object("value", "$.session_meta")
    meta = F.when(m.isNotNull(), F.concat_ws("|", *(F.get_json_object(m, f"$.{k}") for k in ("session_id", "cwd", "git_branch", "harness_version", "harness"))))
    text = F.coalesce(said, meta, F.nullif(at("$.thinking.text"), F.lit("")), at("$.system.text"))
    return rows.select("session_key", F.col("seq").cast("long").alias("seq"), at("$.kind").alias("kind"), F.coalesce(F.nullif(at("$.tool_call.tool_call_id"), F.lit("")), at("$.tool_result.tool_call_id")).alias("call_id"), text.alias("text"))


@query(f"""WITH {WITH["codex"]} SELECT session_key, count(*) AS events, arg_min(kind, seq) AS first, arg_max(kind, seq) AS last, sum(input_tokens)::BIGINT AS input_tokens FROM flat GROUP BY session_key""")
def sink_sessions_json(spark, d):
    """Sessions as documents, read back."""
    rows = sinks.sessions_json(parsed(spark, d, "codex").events, pretty=False)
    kinds = F.from_json(F.get_json_object("value", "$.events[*].kind"), "array<string>")
    return rows.select("session_key", F.size(kinds).cast("long").alias("events"), F.get(kinds, F.lit(0)).alias("first"), F.element_at(kinds, -1).alias("last"), F.get_json_object("value", "$.totals.input_tokens").cast("long").alias("input_tokens"))


@query(f"""WITH {WITH["codex"]} SELECT session_key, count(*) AS events, count(*) FILTER (WHERE kind = 'tool_call') AS tool_calls, count(*) FILTER (WHERE kind = 'thinking') AS thinking, string_agg(DISTINCT model, ',' ORDER BY model) FILTER (WHERE model <> '') AS models FROM flat GROUP BY session_key""")
def sink_stats_json(spark, d):
    rows = sinks.stats_json(written(parsed(spark, d, "codex").events, "events"))
    models = F.array_join(F.array_sort(F.from_json(F.get_json_object("value", "$.models"), "array<string>")), ",")
    at = lambda p: F.coalesce(F.get_json_object("value", p).cast("long"), F.lit(0))
    return rows.select("session_key", at("$.events").alias("events"), at("$.tool_calls").alias("tool_calls"), at("$.event_counts.thinking").alias("thinking"), models.alias("models"))


@query(f"""WITH {WITH["codex"]}, u AS (SELECT session_key, seq, kind, text, call_id FROM flat WHERE kind IN ('tool_call', 'tool_result') OR kind IN ('user_message', 'assistant_message', 'thinking') AND text <> '')
  SELECT session_key, seq, CASE kind WHEN 'user_message' THEN 'user_message_chunk' WHEN 'assistant_message' THEN 'agent_message_chunk' WHEN 'thinking' THEN 'agent_thought_chunk' WHEN 'tool_call' THEN 'tool_call' ELSE 'tool_call_update' END AS update, call_id, CASE WHEN kind = 'tool_call' THEN '' ELSE text END AS text FROM u""")
def sink_acp_json(spark, d):
    rows = sinks.acp_json(acp.acp_updates(parsed(spark, d, "codex").events))
    at = lambda p: F.coalesce(F.get_json_object("value", p), F.lit(""))
    text = F.coalesce(F.get_json_object("value", "$.content.text"), F.get_json_object("value", "$.content[0].content.text"), F.lit(""))
    return rows.select("session_key", F.col("seq").cast("long").alias("seq"), at("$.sessionUpdate").alias("update"), at("$.toolCallId").alias("call_id"), text.alias("text"))


@query(f"""WITH {WITH["codex"]}, s AS (SELECT 'event_msg/' || CASE WHEN k % 2 = 0 THEN ['user_message', 'agent_message', 'agent_reasoning'][k % 3 + 1] ELSE 'x_delta' END AS t, count(*) AS n FROM x WHERE r = 'skip' GROUP BY 1)
  SELECT (SELECT count(*) FROM flat) || ' events, ' || sum(n) || ' skipped records (' || string_agg(t || ' ' || n, ', ' ORDER BY t) || ')' AS summary FROM s""")
def sink_skip_summary(spark, d):
    found = parsed(spark, d, "codex")
    counts = {r["record_type"]: r["count"] for r in found.skips.groupBy("record_type").count().collect()}
    return spark.createDataFrame([(sinks.skip_summary(found.events.count(), counts),)], "summary string")


@query(f"""WITH {X}, t AS (SELECT CASE r WHEN 'signup' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'purchase' THEN 'assistant' WHEN 'view' THEN 'user' WHEN 'error' THEN ['assistant', 'user', 'attachment', 'system'][k % 4 + 1] END AS record_type, * FROM x WHERE r NOT IN ('skip', 'novel'))
  SELECT DISTINCT record_type, 'message.content[].name' AS path, CASE WHEN k % 13 = 11 THEN 'mcp__*' ELSE ['Read', 'Glob', 'Grep', 'ToolSearch', 'Bash', 'Edit', 'Write', 'NotebookEdit', 'WebFetch', 'WebSearch', 'TodoWrite', '', 'Other'][k % 13 + 1] END AS value FROM t WHERE r = 'click'
  UNION SELECT 'assistant', 'message.content[].type', unnest(CASE WHEN r = 'click' THEN ['tool_use'] || CASE WHEN k % 2 = 0 THEN ['thinking'] ELSE [] END WHEN r = 'purchase' THEN CASE WHEN k % 4 <> 0 THEN ['text'] ELSE [] END || CASE WHEN k % 6 = 0 THEN ['fallback'] ELSE [] END ELSE ['text'] END) FROM t WHERE record_type = 'assistant'
  UNION SELECT 'user', 'message.content[].type', unnest(CASE WHEN r = 'signup' THEN CASE WHEN k % 3 = 0 THEN ['text', 'image'] ELSE [] END WHEN r = 'view' THEN ['tool_result'] || CASE WHEN k % 7 = 0 THEN ['text'] ELSE [] END ELSE ['tool_result'] END) FROM t WHERE record_type = 'user'""")
def native_vocabulary(spark, d):
    return drift.vocabulary(rich_lines(spark, d, "claude-code"), "claude-code").where("facet = 'value'").select("record_type", "path", "value")


@query(f"""WITH {X} SELECT h || ':' || session_key AS session_key, h AS harness, CASE WHEN bool_or(r = 'novel') THEN 'drift' ELSE 'clean' END AS category FROM x, (SELECT unnest(['antigravity', 'claude-code', 'codex']) AS h)
  WHERE NOT EXISTS (SELECT 1 FROM x f WHERE f.session_key = x.session_key AND f.n = 1 AND f.r IN ('novel', 'skip') AND h <> 'codex') GROUP BY h, session_key
  UNION ALL SELECT 'lost:' || user_id, NULL, 'exec-error' FROM events WHERE event_id % 100 = 7 GROUP BY user_id""")
def drift_scan_files(spark, d):
    """Files of three formats and of none, scanned together against a baseline of all but the novel records."""
    from pyspark.sql import Window

    def rich(h: str) -> DataFrame:
        # A first line that is no event may not tell its format; such files are another query's.
        head = F.lower("text").contains('"novel"') | F.get_json_object("text", "$.type").isin("CONVERSATION_HISTORY", *discover_skips())
        odd = F.max(F.when(F.col("line") == 1, head)).over(Window.partitionBy("session_key")) if h != "codex" else F.lit(False)
        return rich_lines(spark, d, h).select(F.concat(F.lit(h + ":"), "session_key").alias("session_key"), "line", "text", F.coalesce(odd, F.lit(False)).alias("odd"))

    lost = spark.read.parquet(f"{d}/events.parquet").where("event_id % 100 = 7").select(F.concat(F.lit("lost:"), "user_id").alias("session_key")).distinct()
    lost = lost.select("session_key", F.lit(1).alias("line"), F.lit("no record").alias("text"), F.lit(False).alias("odd"), F.lit("").alias("harness"))
    lines = written(_all(rich).unionByName(lost), "lines", "harness")
    base = None
    for h in HARNESSES:
        own = drift.vocabulary(lines.where((F.col("harness") == h) & ~F.lower("text").contains('"novel"')), h)
        base = own if base is None else base.unionByName(own)
    return drift.scan(lines.where("not odd").select("session_key", "line", "text"), written(base, "baseline"), tasks_of(spark, d))[0]


def discover_skips() -> tuple[str, ...]:
    from ..sources.decode import CLAUDE_SKIP

    return CLAUDE_SKIP


@query("SELECT harness, category FROM (VALUES ('antigravity', 'clean'), ('claude-code', 'clean'), ('codex', 'clean')) v(harness, category)")
def drift_shipped_baseline(spark, d):
    """Plain conversations are clean by the library's own baselines."""
    from .bridge import native_lines

    lines = None
    for h in HARNESSES:
        own = native_lines(spark, d, h).select(F.concat(F.lit(h + ":"), "session_key").alias("session_key"), "line", "text")
        lines = own if lines is None else lines.unionByName(own)
    return drift.scan(written(lines, "lines"), baselines.shipped(spark))[0].select("harness", "category").distinct()


@query("""SELECT 'codex' AS harness, event_type AS record_type, 'type' AS facet, '' AS value FROM events GROUP BY ALL UNION ALL SELECT DISTINCT 'codex', event_type, 'key', unnest(['type', 'user', 'payload', 'payload.k']) FROM events""")
def sink_baseline_json(spark, d):
    """A baseline written as JSON and read again."""
    e = spark.read.parquet(f"{d}/events.parquet")
    lines = e.select(F.format_string('{"type":"%s","user":%d,"payload":%s}', "event_type", "user_id", "props").alias("text"))
    doc = sinks.baseline_json(drift.vocabulary(lines, "codex"), "1.0").first()["value"]
    return sinks.read_baseline(doc, spark).select("harness", "record_type", "facet", "value")


@query(f"""WITH {X}, f AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY n) AS i FROM x)
  SELECT session_key, CASE WHEN r IN ('purchase') OR r = 'click' THEN 'claude-code' WHEN r IN ('signup', 'view', 'error') THEN 'claude-code' WHEN r = 'skip' AND k % 7 IN (4, 5) THEN 'claude-code' WHEN r = 'skip' THEN 'claude-code' END AS harness,
    CASE WHEN r IN ('signup', 'click', 'purchase', 'view', 'error') THEN 'certain' WHEN r = 'skip' AND k % 7 IN (4, 5) THEN 'certain' WHEN r = 'skip' THEN 'possible' ELSE 'no-match' END AS confidence FROM f WHERE i = 1""")
def detect_first_lines(spark, d):
    """First lines of every kind: conversation records, records to skip and unknown ones."""
    return detect(rich_lines(spark, d, "claude-code"))


@query("""SELECT event_id::VARCHAR AS session_key, CASE WHEN event_id % 3 = 0 THEN 'codex' WHEN event_id % 3 = 1 THEN 'codex' ELSE 'claude-code' END AS harness, CASE WHEN event_id % 3 < 2 AND event_id % 50 > 2 THEN 'certain' ELSE 'possible' END AS confidence FROM events""")
def detect_long_lines(spark, d):
    """First lines longer than the window that detection looks at count by the names in it."""
    e = spark.read.parquet(f"{d}/events.parquet")
    pad = F.when(F.col("event_id") % 50 > 2, "x").otherwise(F.repeat(F.lit("x"), 70_000))
    codex = F.concat(F.lit('{"type":"session_meta","payload":{"id":"a","cli_version":"1"},"pad":"'), pad, F.lit('"}'))
    claude = F.concat(F.lit('{"parentUuid":null,"sessionId":"a","type":"user","pad":"'), pad, F.lit('"}'))
    return detect(e.select(F.col("event_id").cast("string").alias("session_key"), F.lit(1).alias("line"), F.when(F.col("event_id") % 3 < 2, codex).otherwise(claude).alias("text")))


@query("""WITH c AS (SELECT conv_id::VARCHAR AS session_key, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM conversations)
  SELECT session_key, line, sha256(text) AS sha FROM c WHERE text <> ''""")
def numbered_lines(spark, d):
    """Lines with carriage returns, blank ones between and a byte-order mark in front."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = c.select(F.col("conv_id").cast("string").alias("session_key"), F.lit(0).cast("long").alias("block"), pos.cast("long").alias("pos"), "text")
    mark = F.when(F.col("pos") == 1, "﻿").otherwise("")
    raw = c.withColumn("value", F.concat(mark, F.lit(" \t"), F.coalesce("text", F.lit("")), F.lit("\r")))
    return numbered(raw.select("session_key", "block", "pos", "value")).select("session_key", F.col("line").cast("long").alias("line"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def _files(spark, d, harness: str) -> DataFrame:
    """Events as files below a root: sessions, their subagents and side files; every seventh user's have no transcript."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("g", F.floor(F.col("event_id") / 4).cast("long")).withColumn("i", F.col("event_id") % 4)
    p, s = F.concat(F.lit("p"), (F.col("g") % 5).cast("string")), F.concat(F.lit("s-"), F.col("g").cast("string"))
    main, lone = F.col("i") == 0, F.col("g") % 7 == 3
    if harness == "claude-code":
        rel = (
            F.when(main & lone, F.concat(s, F.lit(".txt")))
            .when(main, F.concat(p, F.lit("/"), s, F.lit(".jsonl")))
            .when(F.col("i") == 1, F.concat(p, F.lit("/"), s, F.lit("/subagents/agent-"), F.col("i").cast("string"), F.lit(".jsonl")))
            .when(F.col("i") == 2, F.concat(p, F.lit("/"), s, F.when(F.col("g") % 2 == 0, "/subagents/agent-x.jsonl").otherwise("/subagents/notes.md")))
            .otherwise(F.concat(p, F.lit("/"), s, F.when(F.col("g") % 2 == 0, "/tool/out.json").otherwise(".bak")))
        )
    elif harness == "codex":
        rel = F.concat(F.lit("2026/01/"), F.lpad((F.col("g") % 28 + 1).cast("string"), 2, "0"), F.when(F.col("i") < 2, "/rollout-").otherwise("/log-"), s, F.when(F.col("i") == 1, ".json").otherwise(".jsonl"))
    else:
        rel = F.when(main & lone, s).when(main, F.concat(s, F.lit("/.system_generated/logs/transcript_full.jsonl"))).otherwise(F.concat(s, F.lit("/side-"), F.col("i").cast("string")))
    return discover.classify(e.select(F.concat(F.lit("/root/"), rel).alias("path"), rel.alias("rel"), F.col("event_id").alias("mtime_us"), F.lit(1).cast("long").alias("length")), harness)


_G = "WITH g AS (SELECT event_id // 4 AS g, event_id % 4 AS i, 'p' || (event_id // 4 % 5) AS p, 's-' || (event_id // 4) AS s, event_id // 4 % 7 = 3 AS lone, event_id FROM events)"


@query(f"""{_G}, c AS (
  SELECT CASE WHEN i = 0 AND lone THEN s || '.txt' WHEN i = 0 THEN p || '/' || s || '.jsonl' WHEN i = 1 THEN p || '/' || s || '/subagents/agent-1.jsonl' WHEN i = 2 THEN p || '/' || s || CASE WHEN g % 2 = 0 THEN '/subagents/agent-x.jsonl' ELSE '/subagents/notes.md' END ELSE p || '/' || s || CASE WHEN g % 2 = 0 THEN '/tool/out.json' ELSE '.bak' END END AS rel,
    CASE WHEN i = 0 AND NOT lone THEN 'main' WHEN i = 1 OR i = 2 AND g % 2 = 0 THEN 'subagent' END AS role, CASE WHEN i = 0 AND lone THEN 'not a project directory' WHEN i = 2 AND g % 2 = 1 THEN 'not a subagent transcript' WHEN i = 3 AND g % 2 = 0 THEN 'session directory sidecar' WHEN i = 3 THEN 'not a session transcript' END AS reason FROM g)
  SELECT 'claude-code' AS harness, * FROM c
  UNION ALL SELECT 'codex', '2026/01/' || lpad((g % 28 + 1)::VARCHAR, 2, '0') || CASE WHEN i < 2 THEN '/rollout-' ELSE '/log-' END || s || CASE WHEN i = 1 THEN '.json' ELSE '.jsonl' END, CASE WHEN i = 0 THEN 'main' END, CASE WHEN i > 0 THEN 'not a session transcript' END FROM g
  UNION ALL SELECT 'antigravity', CASE WHEN i = 0 AND lone THEN s WHEN i = 0 THEN s || '/.system_generated/logs/transcript_full.jsonl' ELSE s || '/side-' || i END, CASE WHEN i = 0 AND NOT lone THEN 'main' END,
    CASE WHEN i = 0 AND lone THEN 'not a conversation directory' WHEN i > 0 AND lone THEN 'conversation directory without transcript' WHEN i > 0 THEN 'conversation sidecar' END FROM g""")
def discover_classify(spark, d):
    return _all(lambda h: _files(spark, d, h).select("rel", "role", "reason"))


@query(f"""{_G}, a AS (SELECT g, '/root/' || p || '/' || s || CASE WHEN i = 1 THEN '/subagents/agent-1.jsonl' ELSE '/subagents/agent-x.jsonl' END AS path FROM g WHERE i = 1 OR i = 2 AND g % 2 = 0)
  SELECT '/root/' || p || '/' || s || '.jsonl' AS path, coalesce((SELECT string_agg(a.path, ',' ORDER BY a.path) FROM a WHERE a.g = g.g), '') AS subagents FROM g WHERE i = 0 AND NOT lone
  UNION ALL SELECT a.path, '' FROM a WHERE g % 7 = 3 OR NOT EXISTS (SELECT 1 FROM g WHERE g.g = a.g AND g.i = 0)""")
def discover_references(spark, d):
    """Sessions with their subagents; subagents without a session stand for themselves."""
    return discover.references(_files(spark, d, "claude-code")).select("path", F.array_join("subagent_paths", ",").alias("subagents"))


@query(f"""{_G}, a AS (SELECT g, '/root/' || p || '/' || s AS q, i FROM g WHERE i = 1 OR i = 2 AND g % 2 = 0)
  SELECT '/root/' || p || '/' || s || '.jsonl' AS value FROM g WHERE i = 0 AND NOT lone UNION ALL SELECT q || CASE WHEN i = 1 THEN '/subagents/agent-1.jsonl' ELSE '/subagents/agent-x.jsonl' END FROM a""")
def sink_reference_paths(spark, d):
    return sinks.ref_paths(discover.references(_files(spark, d, "claude-code")))


@query(f"""{_G} SELECT s || '.txt' AS rel FROM g WHERE false UNION ALL SELECT '2026/01/' || lpad((g % 28 + 1)::VARCHAR, 2, '0') || '/rollout-' || s || '.jsonl' FROM g WHERE i = 0 AND g % 28 + 1 BETWEEN 8 AND 21""")
def discover_day_window(spark, d):
    """Day directories a whole day or more outside 10 to 20 January are not opened."""
    day = lambda n: (1_767_225_600 + n * 86_400) * 1_000_000
    files = _files(spark, d, "codex").where("role = 'main'")
    return files.where(discover.in_day_window(F.col("rel"), day(9), day(19))).select("rel")


@query(f"""{_G}, r AS (SELECT DISTINCT '/root/' || p || '/' || s || '.jsonl' AS path, event_id FROM g WHERE i = 0 AND NOT lone) SELECT path, row_number() OVER (ORDER BY event_id % 10, path) - 1 AS age_ord FROM r""")
def discover_oldest_first(spark, d):
    refs = discover.references(_files(spark, d, "claude-code").withColumn("mtime_us", F.col("mtime_us") % 10)).where("path like '%.jsonl' and path not like '%/subagents/%'").withColumn("harness", F.lit("claude-code"))
    return discover.oldest_first(refs).select("path", "age_ord")


@query(f"""{_G}, r AS (SELECT DISTINCT g, s, p FROM g WHERE i = 0 AND NOT lone) SELECT '/root/' || p || '/' || s || '.jsonl' AS path FROM r WHERE s = 's-12'""")
def discover_named(spark, d):
    """The files that may be a session's, by name alone."""
    refs = discover.references(_files(spark, d, "claude-code"))
    return refs.where(discover.named(F.col("path"), "claude-code", "s-12")).select("path")


@query(f"""{_G} SELECT DISTINCT '/root/' || s || '.txt' AS path FROM g WHERE i = 0 AND lone AND g % 2 = 1""")
def discover_uncovered_files(spark, d):
    """Every file is a reference, a subagent, a skip or an error; skips at even places are withheld here."""
    files = _files(spark, d, "claude-code")
    none = files.where("false").select("path")
    skips = files.where("reason is not null").where("not (reason = 'not a project directory' and floor(mtime_us / 4) % 2 = 1)").select("path")
    return validate.uncovered_files(files, discover.references(files), skips, none)


@query(f"""WITH {WITH["codex"]} SELECT session_key, '/w/' || session_key AS cwd, session_key AS session_id, 1767225600000000 AS started_us FROM flat GROUP BY session_key""")
def discover_identities(spark, d):
    known = discover.identities(rich_lines(spark, d, "codex"), "codex").where("problem is null")
    return known.select("session_key", "meta.cwd", "meta.session_id", "started_us")


@query(f"""WITH {X}, f AS (SELECT session_key, min(n) AS n FROM x WHERE r <> 'skip' GROUP BY session_key)
  SELECT f.session_key, CASE WHEN r <> 'novel' THEN '/w/' || f.session_key END AS cwd, CASE WHEN r = 'novel' THEN 'unrecognized record type "novel"' END AS problem FROM f JOIN x USING (session_key, n)""")
def discover_first_events(spark, d):
    """The first record that is not skipped says whose a transcript is, or that it can't be told."""
    return discover.identities(rich_lines(spark, d, "claude-code"), "claude-code").select("session_key", "meta.cwd", "problem")


@query("""WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '/w/a' WHEN 1 THEN '/w//a/' WHEN 2 THEN '/w/b' WHEN 3 THEN '' END AS cwd, 's' || (event_id % 3) AS session_id FROM events)
  SELECT event_id, CASE WHEN session_id <> 's1' THEN 'session id' WHEN coalesce(cwd, '') = '' THEN 'no recorded cwd' WHEN cwd NOT IN ('/w/a', '/w//a/') THEN 'cwd' END AS filter_reason FROM r""")
def discover_filters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.col("event_id") % 5
    refs = e.select("event_id", F.when(n == 0, "/w/a").when(n == 1, "/w//a/").when(n == 2, "/w/b").when(n == 3, "").alias("cwd"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("session_id"))
    return discover.filtered(refs, "s1", "/w/./a").select("event_id", "filter_reason")


@query("""WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN '/w/a' WHEN 1 THEN '/w//a/' WHEN 2 THEN '/w/b' WHEN 3 THEN '' END AS cwd, 's' || (event_id % 3) AS session_id FROM events),
  x AS (SELECT CASE WHEN session_id <> 's1' THEN 'session id' WHEN coalesce(cwd, '') = '' THEN 'no recorded cwd' WHEN cwd NOT IN ('/w/a', '/w//a/') THEN 'cwd' END AS f FROM r)
  SELECT count(*) FILTER (WHERE f IS NULL) AS matched, count(*) FILTER (WHERE f IS NOT NULL) AS filtered, count(*) FILTER (WHERE f = 'no recorded cwd') AS no_cwd FROM x""")
def discover_summary(spark, d):
    return discover.summary(discover_filters(spark, d))


@query(r"""WITH i AS (SELECT event_id, CASE WHEN event_id % 11 = 9 THEN '' ELSE event_type || ['-', '/', '\', '..', '*', '?', '[', '.', ''][event_id % 11 + 1] || user_id END AS id FROM events WHERE event_id % 11 < 10 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 11 = 10)
  SELECT event_id, id, id <> '' AND NOT regexp_matches(id, '[/\\*?\[]') AND id NOT LIKE '%..%' AS safe FROM i""")
def session_id_check(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id") % 11
    mark = F.get(F.array(*map(F.lit, ("-", "/", "\\", "..", "*", "?", "[", ".", ""))), k.cast("int"))
    ident = F.when(k == 9, "").when(k == 10, F.col("event_type")).otherwise(F.concat("event_type", mark, F.col("user_id").cast("string")))
    return e.select("event_id", ident.alias("id")).withColumn("safe", safe_session_id(F.col("id")))


@query("""SELECT event_id, epoch_us(date_trunc('second', ts)) + event_id % 1000 * 1000 - (event_id % 5 - 2) * 3600 * 1000000 AS us FROM events WHERE event_id % 4 > 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0""")
def parse_times(spark, d):
    """Times with fractions and offsets; those without a zone don't count."""
    e = spark.read.parquet(f"{d}/events.parquet")
    hours = F.col("event_id") % 5 - 2
    zone = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.when(hours < 0, "-").otherwise("+"), F.lit("0"), F.abs(hours).cast("string"), F.lit(":00")))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), zone)
    return e.select("event_id", parse_time(text).alias("us"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(date_trunc('second', ts)) WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000 END AS us FROM events""")
def parse_when(spark, d):
    """Times given on a command line; a time without a zone, and words, can't be read."""

    def one(text: str) -> int | None:
        try:
            return discover.parse_when(text)
        except ValueError:
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array([one(t) for t in b.column("text").to_pylist()], pa.int64())], names=["event_id", "us"])

    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, second).when(k == 1, F.concat(second, F.lit("Z"))).when(k == 2, F.concat(second, F.lit("+02:00"))).otherwise(F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("text")).mapInArrow(run, "event_id long, us long")


@query("""SELECT o_orderkey, h AS harness, CASE h WHEN 'antigravity' THEN o_orderkey % 20 > 10 AND o_custkey % 3 >= 1 OR o_custkey % 3 > 1 ELSE o_orderkey % 300 > 212 AND o_custkey % 3 = 2 END AS newer FROM orders, (SELECT unnest(['antigravity', 'claude-code']) AS h)""")
def version_gate(spark, d):
    """Versions against the newest that was validated."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    part = lambda h, text: o.select("o_orderkey", F.lit(h).alias("harness"), version_newer(text, F.lit(LAST_VALIDATED[h])).alias("newer"))
    ag = F.format_string("%d.1.%d", F.col("o_custkey") % 3, F.col("o_orderkey") % 20)
    cc = F.format_string("%d.1.%d", F.col("o_custkey") % 3, F.col("o_orderkey") % 300)
    return part("antigravity", ag).unionByName(part("claude-code", cc))


@query("SELECT conv_id, turn, right(hex(encode(text)), 42) AS ends FROM conversations")
def output_tail(spark, d):
    """The last 21 bytes, which may begin within a character."""
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.hex(tail(F.col("text"), 21)).alias("ends"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS outside FROM events")
def foreign_directories(spark, d):
    n = F.col("event_id") % 4
    cwd = F.when(n == 0, "/w/a/").when(n == 1, "/w/./a").when(n == 2, "/w/ab")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", foreign_cwd(cwd, F.lit("/w//a")).alias("outside"))


@query(f"""WITH {WITH["codex"]}, c AS (SELECT session_key, seq, call_id, name, tool_kind FROM flat WHERE kind = 'tool_call'),
  a AS (SELECT session_key, seq, name, tool_kind, EXISTS (SELECT 1 FROM flat r WHERE r.session_key = c.session_key AND r.kind = 'tool_result' AND r.call_id = c.call_id AND r.seq > c.seq AND NOT EXISTS (SELECT 1 FROM c d WHERE d.session_key = c.session_key AND d.call_id = c.call_id AND d.seq > c.seq AND d.seq < r.seq)) AS answered FROM c),
  s AS (SELECT session_key, bool_or(kind = 'assistant_message' AND text <> '') AS said, count(*) FILTER (WHERE kind = 'tool_call') AS calls FROM flat GROUP BY session_key),
  t AS (SELECT session_key, bool_or(answered AND tool_kind = 'execute') AS ran, bool_or(answered AND name = 'exec') AS e, bool_or(answered AND name = 'web_search') AS w FROM a GROUP BY session_key)
  SELECT session_key, said, coalesce(ran, false) AS ran, CASE WHEN NOT coalesce(e, false) AND NOT coalesce(w, false) THEN 'tools: exec, web_search' WHEN NOT coalesce(e, false) THEN 'tools: exec' WHEN NOT coalesce(w, false) THEN 'tools: web_search' ELSE '' END AS tools, calls >= 12 AS busy,
    CASE WHEN said AND coalesce(ran, false) AND coalesce(e, false) AND coalesce(w, false) AND calls >= 12 THEN 'clean' ELSE 'inconclusive' END AS category FROM s LEFT JOIN t USING (session_key)""")
def probe_outcomes(spark, d):
    """What sessions were expected to show, and what is missing."""
    e = written(parsed(spark, d, "codex").events, "events")
    lacks = {"said": probes.missing_answer(e), "ran": probes.missing_tool_kind(e, "execute"), "tools": probes.missing_tools(e, ("exec", "web_search")), "busy": probes.missing_calls(e, 12)}
    out = probes.outcome(e, *lacks.values())
    for name, rows in lacks.items():
        out = out.join(rows.withColumnRenamed("missing", name), "session_key", "left")
    return out.select("session_key", "category", F.col("said").isNull().alias("said"), F.col("ran").isNull().alias("ran"), F.coalesce("tools", F.lit("")).alias("tools"), F.col("busy").isNull().alias("busy"))


@query("SELECT user_id::VARCHAR AS session_key, 'duplicate session_meta' AS violation, 1::BIGINT AS n FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) > 1")
def duplicate_meta(spark, d):
    """Sign-ups stand for opening records here; a second one in a session is against the rules."""
    from .bridge import shaped
    from .schema import META

    e = event_sessions(spark, d)
    signup = F.col("kind") == "user_message"
    e = e.withColumn("meta", F.when(signup, shaped(META, harness=F.lit("codex")))).withColumn("user_message", F.lit(None).cast(e.schema["user_message"].dataType)).withColumn("kind", F.when(signup, "session_meta").otherwise(F.col("kind")))
    return validate.violations(e).groupBy("session_key", "violation").agg(F.count("*").alias("n"))
