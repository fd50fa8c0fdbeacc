"""Queries over the driver's tables, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_bytes, digest, overlaps_window, truncate_block, version_newer
from ..operators import acp, drift, interactions, probes, promote, segments, sequence, stats, validate
from ..sources import detect
from ..sources.transcripts import parse
from .bridge import conversation_sessions, event_sessions, native_lines, shaped, text_blocks
from . import native_queries, stream_queries
from .schema import SYSTEM

Query = Callable[[SparkSession, str], DataFrame]
LONG = 2**63 - 1


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.session_stats(event_sessions(spark, d))


def event_kind_counts(spark, d):
    return event_sessions(spark, d).groupBy("session_key", "kind").agg(F.count("*").alias("n"))


def message_origin_counts(spark, d):
    return stats.session_counts(event_sessions(spark, d)).select("session_key", "user_messages", "harness_messages")


def _long(metric: str) -> Query:
    return lambda spark, d: stats.long_stats(event_sessions(spark, d)).where(F.col("metric") == metric).select("session_key", "key", "value")


def tool_interactions(spark, d):
    rows = interactions.tool_interactions(event_sessions(spark, d))
    return rows.select("session_key", "seq", "tool_call_id", "has_call", F.size("results").cast("long").alias("n_results"), F.array_join(F.transform("results", lambda r: r["seq"].cast("string")), ",").alias("result_seqs"))


def unanswered_calls(spark, d):
    return stats.interaction_rows(event_sessions(spark, d)).where("has_call and n_results = 0").select("session_key", "seq", "tool")


def orphan_results(spark, d):
    return stats.interaction_rows(event_sessions(spark, d)).where("not has_call").select("session_key", "seq", "tool_call_id")


def tool_errors(spark, d):
    return stats.tool_totals(event_sessions(spark, d)).select("session_key", "tool_errors")


def system_by_subtype(spark, d):
    return stats.long_stats(conversation_sessions(spark, d)).where("metric = 'system_by_subtype'").select("session_key", "key", "value")


def models_first_observed(spark, d):
    return stats.models_observed(event_sessions(spark, d))


def session_totals(spark, d):
    return stats.session_counts(event_sessions(spark, d)).select("session_key", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def session_wall_time(spark, d):
    return stats.session_counts(event_sessions(spark, d)).select("session_key", "start_us", "end_us", "wall_time_ms")


def final_answer(spark, d):
    return stats.session_counts(conversation_sessions(spark, d)).select("session_key", "final_answer")


def session_report(spark, d):
    found = parse(native_lines(spark, d, "codex"), "codex")
    return stats.session_report(event_sessions(spark, d), found.skips)


def acp_updates(spark, d):
    return acp.acp_updates(event_sessions(spark, d)).select("session_key", "seq", "block_idx", "update", "text", "tool_call_id", "title", "tool_kind", "status")


def _loss(kind: str) -> Query:
    return lambda spark, d: acp.acp_loss(conversation_sessions(spark, d).unionByName(event_sessions(spark, d))).where(F.col("loss_type") == kind).groupBy("key").agg(F.sum("value").alias("value"))


#: Lines in a segment of the queries over cut sessions.
SEGMENT_LINES = 16


def _segmented(query: Callable[..., DataFrame]) -> Query:
    """A query of sequence operators over sessions cut into segments."""
    return lambda spark, d: query(spark, d, segments, lambda rows: segments.cut(rows, "seq", SEGMENT_LINES))


def _uncut(rows: DataFrame) -> DataFrame:
    return rows


def codex_usage_pool(spark, d, ops=sequence, cut=_uncut):
    """Purchases open anchors, clicks and sign-ups close them, views count tokens."""
    e = event_sessions(spark, d)
    opens, closes = F.col("kind") == "assistant_message", F.col("kind").isin("assistant_message", "tool_call", "user_message")
    tokens = F.when(F.col("kind") == "tool_result", F.col("tool_result.tool_call_id").cast("long"))
    rows = ops.closing_lines(cut(e.select("session_key", "seq", "kind", tokens.alias("tokens"), opens.alias("o"), closes.alias("c"))), F.col("o"), F.col("c"), "seq")
    pools = rows.where("tokens is not null and owner_close is not null").groupBy("session_key", "owner_close").agg(F.sum("tokens").alias("tokens"))
    anchors = rows.where("o").select("session_key", "seq", F.coalesce("close_line", F.lit(LONG)).alias("owner_close"))
    return anchors.join(pools, ["session_key", "owner_close"], "left").select("session_key", "seq", F.when(F.col("owner_close") < LONG, F.col("owner_close")).alias("close_seq"), "tokens")


def claude_fold(spark, d, ops=sequence, cut=_uncut):
    """Runs of results with the same tool id modulo 3 fold; the last purchase text, first and last place stay."""
    e = event_sessions(spark, d).where("kind = 'tool_result'").select("session_key", "seq", (F.col("tool_result.tool_call_id").cast("long") % 3).alias("mid"), F.col("tool_result.tool_call_id").cast("long").alias("usage"))
    rows = ops.fold_islands(cut(e), "mid", "seq")
    return rows.groupBy("session_key", "island", "mid").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("usage", "seq").alias("usage"), F.count("*").alias("n")).withColumn("island", F.col("island").cast("long"))


def resumed_folds(spark, d):
    e = event_sessions(spark, d).where("kind = 'tool_result'").select("session_key", "seq", (F.col("tool_result.tool_call_id").cast("long") % 3).alias("mid"))
    return sequence.resumed_folds(sequence.fold_islands(e, "mid", "seq"), "mid", "seq").select("session_key", "mid", F.col("island").cast("long").alias("island"), "seq")


def antigravity_fifo(spark, d, ops=sequence, cut=_uncut):
    """Purchases plan as many calls as their id modulo 4, views and errors take them in order."""
    e = event_sessions(spark, d)
    plan, take = F.col("kind") == "assistant_message", F.col("kind") == "tool_result"
    calls = (F.col("assistant_message.usage.input_tokens") % 4).cast("int")
    rows = ops.fifo_match(cut(e.select("session_key", "seq", plan.alias("p"), take.alias("t"), calls.alias("n"))), F.col("p"), F.col("t"), F.col("n"), "seq")
    return rows.where("t").select("session_key", "seq", F.col("call_owner").alias("plan_seq"), F.col("call_index").cast("long").alias("call_index"))


def model_carry_forward(spark, d, ops=sequence, cut=_uncut):
    e = event_sessions(spark, d).select("session_key", "seq", F.col("assistant_message.model").alias("model"))
    return ops.carry_forward(cut(e), "model", "seq", "model_now").select("session_key", "seq", "model_now")


def step_order_sort(spark, d):
    e = event_sessions(spark, d).select("session_key", "seq", F.when(F.col("kind") != "user_message", F.coalesce(F.col("tool_call.tool_call_id"), F.col("tool_result.tool_call_id")).cast("long")).alias("step"))
    return sequence.step_order(e, "step", "seq").select("session_key", "seq", "step_ord")


def _telemetry(spark, d):
    """Sign-ups as telemetry: even ids patches, odd ids searches."""
    e = event_sessions(spark, d)
    n = F.get_json_object(F.get("user_message.content", F.lit(0))["text"], "$.k").cast("long")
    even = n % 2 == 0
    details = F.when(even, F.format_string('{"call_id":"p%d","changes":{"n":%d},"success":%s}', n, n, F.when(n % 4 == 0, "true").otherwise("false"))).otherwise(F.format_string('{"action":{"q":%d}}', n))
    system = F.when(F.col("kind") == "user_message", shaped(SYSTEM, subtype=F.when(even, "patch_apply_end").otherwise("web_search_end"), details=details))
    e = e.withColumn("system", system).withColumn("kind", F.when(F.col("kind") == "user_message", "system").otherwise(F.col("kind")))
    return e.withColumn("user_message", F.lit(None).cast(e.schema["user_message"].dataType))


def promote_telemetry(spark, d):
    e = _telemetry(spark, d)
    for name in ("codex:patch-apply", "codex:web-search"):
        e = promote.resolve([name], "codex")[0](e)
    out = e.where(F.coalesce("tool_call.promoted_from", "tool_result.promoted_from").isNotNull())
    return out.select("session_key", "seq", "kind", F.coalesce("tool_call.tool_call_id", "tool_result.tool_call_id").alias("tool_call_id"), F.coalesce("tool_call.name", "tool_result.tool_name").alias("tool"), F.col("tool_call.input").alias("input"), F.col("tool_result.is_error").alias("is_error"))


def validate_events(spark, d):
    """Broken on purpose: every seventh call loses its id, every eleventh event gains a second payload."""
    e = event_sessions(spark, d)
    e = e.withColumn("tool_call", F.when(F.col("seq") % 7 == 0, F.col("tool_call").withField("tool_call_id", F.lit(""))).otherwise(F.col("tool_call")))
    e = e.withColumn("system", F.when(F.col("seq") % 11 == 0, shaped(SYSTEM, subtype=F.lit("x"))))
    return validate.violations(e).groupBy("session_key", "violation").agg(F.count("*").alias("n"))


def line_accounting(spark, d):
    """Results cover two lines, calls none; what is left over is not accounted for."""
    e = event_sessions(spark, d)
    lines = e.select("session_key", "line")
    events = e.where("kind <> 'tool_call'").withColumn("end_line", F.when(F.col("kind") == "tool_result", F.col("line") + 1).otherwise(F.col("line")))
    skips = e.where("kind = 'tool_call' and seq % 5 = 0").select("session_key", "line")
    return validate.uncovered_lines(lines, events, skips).select("session_key", F.col("line").cast("long").alias("line"))


def _event_lines(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.format_string('{"type":"%s","user":%d,"payload":%s}', "event_type", "user_id", "props").alias("text"), (F.col("event_id") % 2 == 0).alias("even"), "event_type")


def vocab_keys(spark, d):
    return drift.vocabulary(_event_lines(spark, d), "codex").where("facet = 'key'").select("record_type", "value")


def vocab_discriminators(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    lines = e.select(F.format_string('{"type":"event_msg","payload":{"type":"%s"}}', "event_type").alias("text"))
    return drift.vocabulary(lines, "codex").where("facet = 'value'").select("record_type", "path", "value")


def drift_findings(spark, d):
    """Baseline: every type but clicks, plus one never seen; observed: all events, views with one more key."""
    lines = _event_lines(spark, d)
    base = drift.vocabulary(lines.where("event_type <> 'click'").select("text").unionByName(spark.createDataFrame([('{"type":"retired"}',)], "text string")), "codex")
    seen = lines.withColumn("text", F.when(F.col("event_type") == "view", F.regexp_replace("text", r"\}$", ',"extra":1}')).otherwise(F.col("text")))
    return drift.drift(base, drift.vocabulary(seen, "codex")).select("finding", "record_type", "value")


def truncate_payloads(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", truncate_block(F.get(text_blocks(F.col("text")), F.lit(0)), 1000).alias("b"))
    return docs.select("doc_id", F.length("b.text").cast("long").alias("kept_chars"), "b.truncated", "b.size", "b.digest", content_bytes(F.array("b")).alias("bytes"))


def payload_digest(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", digest(F.col("text")).alias("sha256"))


def version_compare(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    a = F.format_string("%d.%d", F.col("o_orderkey") % 5, F.col("o_custkey") % 7)
    b = F.format_string("%d.%d.%d", F.col("o_custkey") % 5, F.col("o_orderkey") % 3, F.col("o_orderkey") % 2)
    return o.select("o_orderkey", version_newer(a, b).alias("newer"))


def session_window_filter(spark, d):
    """Sessions whose activity meets the middle half of all time; their last event stands for the mtime."""
    s = stats.session_counts(event_sessions(spark, d)).select("session_key", F.when(F.col("session_key").cast("long") % 3 > 0, F.col("start_us")).alias("start_us"), "end_us")
    ends = spark.read.parquet(f"{d}/events.parquet")
    from ..functions.columns import ntz_micros

    span = ends.agg(F.min(ntz_micros(F.col("ts"))).alias("lo"), F.max(ntz_micros(F.col("ts"))).alias("hi")).first()
    quarter = (span["hi"] - span["lo"]) // 4
    return s.where(overlaps_window(F.col("start_us"), F.col("end_us"), span["lo"] + quarter, span["hi"] - quarter)).select("session_key")


def detect_format(spark, d):
    out = None
    for h in ("codex", "claude-code", "antigravity"):
        one = detect.detect(native_lines(spark, d, h)).select("session_key", F.lit(h).alias("written_as"), F.col("harness").alias("detected"), "confidence")
        out = one if out is None else out.unionByName(one)
    return out


def _roundtrip(harness: str) -> Query:
    def run(spark, d):
        return _answers(parse(native_lines(spark, d, harness), harness).events)

    return run


def _answers(events: DataFrame) -> DataFrame:
    s = stats.session_counts(events)
    return s.select("session_key", "events", "user_messages", "input_tokens", "output_tokens", F.sha2(F.coalesce("final_answer", F.lit("")).cast("binary"), 256).alias("final_sha256"))


def harness_side_by_side(spark, d):
    e = event_sessions(spark, d)
    s = stats.session_stats(e).withColumn("harness", F.when(F.col("session_key").cast("long") % 2 == 0, "claude-code").otherwise("codex"))
    return stats.side_by_side(s)


def harness_rollup(spark, d):
    s = stats.session_counts(event_sessions(spark, d)).withColumn("harness", F.when(F.col("session_key").cast("long") % 2 == 0, "claude-code").otherwise("codex"))
    return s.rollup("harness", "session_key").agg(F.sum("events").alias("events"), F.sum("input_tokens").alias("input_tokens"))


def fetch_compression(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    raw = F.octet_length("html")
    kept = F.octet_length(F.regexp_replace("html", "<[^>]*>", ""))
    return p.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.sum(kept.cast("long")).alias("content_bytes"), F.sum(raw.cast("long")).alias("raw_bytes"), F.floor(F.sum(kept.cast("long")) * 10000 / F.sum(raw.cast("long"))).cast("long").alias("per_myriad"))


def interactions_predicates(spark, d):
    """Probe predicates: an answer is there, a fetch call has a result, three calls at least."""
    e = event_sessions(spark, d)
    lacks = {"has_answer": probes.missing_answer(e), "fetch_answered": probes.missing_tool_kind(e, "fetch"), "three_calls": probes.missing_calls(e, 3)}
    out = e.select("session_key").distinct()
    for name, rows in lacks.items():
        out = out.join(rows.select("session_key", F.lit(False).alias(name)), "session_key", "left")
    return out.select("session_key", *(F.coalesce(name, F.lit(True)).alias(name) for name in lacks))


def first_claims(spark, d):
    """Users as files, event types as the probes that claim them, in order of their first event."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return validate.first_claims(e.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("owner"), F.col("event_id").alias("ord")))


QUERIES: dict[str, Query] = {
    "stats_summary": stats_summary,
    "event_kind_counts": event_kind_counts,
    "message_origin_counts": message_origin_counts,
    "tool_calls_by_name": _long("tool_calls_by_name"),
    "tool_calls_by_kind": _long("tool_calls_by_kind"),
    "tool_interactions": tool_interactions,
    "unanswered_calls": unanswered_calls,
    "orphan_results": orphan_results,
    "tool_errors": tool_errors,
    "result_bytes_by_tool": _long("result_bytes_by_name"),
    "tool_latency_ms": _long("tool_time_ms_by_name"),
    "system_by_subtype": system_by_subtype,
    "models_first_observed": models_first_observed,
    "session_totals": session_totals,
    "session_wall_time": session_wall_time,
    "final_answer": final_answer,
    "session_report": session_report,
    "acp_updates": acp_updates,
    "acp_loss_totals": _loss("totals"),
    "acp_loss_events": _loss("dropped_events"),
    "acp_loss_fields": _loss("dropped_fields"),
    "codex_usage_pool": codex_usage_pool,
    "claude_fold": claude_fold,
    "resumed_folds": resumed_folds,
    "antigravity_fifo": antigravity_fifo,
    "model_carry_forward": model_carry_forward,
    "step_order_sort": step_order_sort,
    "promote_telemetry": promote_telemetry,
    "validate_events": validate_events,
    "line_accounting": line_accounting,
    "vocab_keys": vocab_keys,
    "vocab_discriminators": vocab_discriminators,
    "drift_findings": drift_findings,
    "truncate_payloads": truncate_payloads,
    "payload_digest": payload_digest,
    "version_compare": version_compare,
    "session_window_filter": session_window_filter,
    "detect_format": detect_format,
    "parse_roundtrip_codex": _roundtrip("codex"),
    "parse_roundtrip_claude": _roundtrip("claude-code"),
    "parse_roundtrip_antigravity": _roundtrip("antigravity"),
    "harness_side_by_side": harness_side_by_side,
    "harness_rollup": harness_rollup,
    "fetch_compression": fetch_compression,
    "probe_predicates": interactions_predicates,
    "first_claims": first_claims,
    **{f"segmented_{q.__name__}": _segmented(q) for q in (codex_usage_pool, claude_fold, antigravity_fifo, model_carry_forward)},
    **native_queries.QUERIES,
    **stream_queries.QUERIES,
}

