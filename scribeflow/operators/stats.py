"""Behavioural statistics of sessions: a wide row each, and the same figures in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blocks_text, content_bytes, millis_between
from .interactions import UNKNOWN_TOOL, tool_interactions


def session_counts(events: DataFrame) -> DataFrame:
    """Counts, token totals (NULL where no usage was recorded), time span and final answer by session."""
    is_kind = lambda k: F.col("kind") == k
    origin = F.col("user_message.origin")
    usage = F.col("assistant_message.usage")
    total = lambda f: F.sum(F.when(usage.isNotNull(), F.coalesce(usage[f], F.lit(0)))).alias(f)
    answer = blocks_text(F.col("assistant_message.content"))
    return events.groupBy("session_key").agg(
        F.count("*").alias("events"),
        F.count_if(is_kind("user_message") & ~(F.coalesce(origin, F.lit("")) == "harness")).alias("user_messages"),
        F.count_if(is_kind("user_message") & (origin == "harness")).alias("harness_messages"),
        *(total(f) for f in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        millis_between(F.min("ts_us"), F.max("ts_us")).alias("wall_time_ms"),
        F.max_by(F.when(answer != "", answer), F.when(is_kind("assistant_message") & (answer != ""), F.col("seq"))).alias("final_answer"),
        F.count_if(is_kind("unknown")).alias("unknown_events"),
    )


def interaction_rows(events: DataFrame) -> DataFrame:
    """Interactions with the figures that the tool statistics add up."""
    first = F.get("results", F.lit(0))["tool_name"]
    name = F.when(F.col("has_call"), F.col("name")).otherwise(F.coalesce(F.nullif(first, F.lit("")), F.lit(UNKNOWN_TOOL)))
    add = lambda f: F.aggregate("results", F.lit(0).cast("long"), lambda n, r: n + f(r))
    last = F.array_max(F.transform("results", lambda r: r["ts_us"]))
    took = last - F.col("call_ts_us")
    return tool_interactions(events).select(
        "session_key",
        "seq",
        "tool_call_id",
        "has_call",
        "call_kind",
        name.alias("tool"),
        F.size("results").cast("long").alias("n_results"),
        add(lambda r: r["is_error"].cast("long")).alias("errors"),
        add(lambda r: r["bytes"]).alias("result_bytes"),
        add(lambda r: F.coalesce(r["fetch_bytes"], F.lit(0))).alias("fetch_raw_bytes"),
        F.when(F.col("has_call") & (took >= 0), F.floor(took / 1000)).cast("long").alias("tool_ms"),
    )


def tool_totals(events: DataFrame) -> DataFrame:
    """Tool figures by session."""
    return interaction_rows(events).groupBy("session_key").agg(
        F.count_if("has_call").alias("tool_calls"),
        F.count_if(F.col("has_call") & (F.col("n_results") == 0)).alias("unanswered_calls"),
        F.sum(F.when(~F.col("has_call"), F.col("n_results")).otherwise(0)).alias("orphan_results"),
        F.sum("errors").alias("tool_errors"),
        F.sum("result_bytes").alias("result_bytes"),
        F.sum("fetch_raw_bytes").alias("fetch_raw_bytes"),
        F.coalesce(F.sum("tool_ms"), F.lit(0)).alias("tool_time_ms"),
    )


def session_stats(events: DataFrame) -> DataFrame:
    """One wide row for each session."""
    tools = ("tool_calls", "unanswered_calls", "orphan_results", "tool_errors", "result_bytes", "fetch_raw_bytes", "tool_time_ms")
    joined = session_counts(events).join(tool_totals(events), "session_key", "left")
    return joined.withColumns({t: F.coalesce(t, F.lit(0)) for t in tools})


def models_observed(events: DataFrame) -> DataFrame:
    """Distinct models of each session in the order of their first message."""
    model = F.col("assistant_message.model")
    firsts = events.where(F.coalesce(model, F.lit("")) != "").groupBy("session_key", model.alias("model")).agg(F.min("seq").alias("first_seq"))
    order = Window.partitionBy("session_key").orderBy("first_seq")
    return firsts.withColumn("model_ord", F.row_number().over(order).cast("long"))


def long_stats(events: DataFrame) -> DataFrame:
    """(session_key, metric, key, value) of every figure that has a key: kinds, tools, subtypes."""
    rows = interaction_rows(events)
    calls = rows.where("has_call")
    parts = [
        events.groupBy("session_key", F.lit("event_counts").alias("metric"), F.col("kind").alias("key")).agg(F.count("*").alias("value")),
        calls.groupBy("session_key", F.lit("tool_calls_by_name").alias("metric"), F.col("tool").alias("key")).agg(F.count("*").alias("value")),
        calls.groupBy("session_key", F.lit("tool_calls_by_kind").alias("metric"), F.col("call_kind").alias("key")).agg(F.count("*").alias("value")),
        rows.where("n_results > 0").groupBy("session_key", F.lit("result_bytes_by_name").alias("metric"), F.col("tool").alias("key")).agg(F.sum("result_bytes").alias("value")),
        rows.where("tool_ms is not null").groupBy("session_key", F.lit("tool_time_ms_by_name").alias("metric"), F.col("tool").alias("key")).agg(F.sum("tool_ms").alias("value")),
        events.where("kind = 'system'").groupBy("session_key", F.lit("system_by_subtype").alias("metric"), F.coalesce("system.subtype", F.lit("")).alias("key")).agg(F.count("*").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def session_report(events: DataFrame, skips: DataFrame) -> DataFrame:
    """(session_key, metric, key, value): skipped records by type, unknown events, orphan results."""
    return (
        skips.groupBy("session_key", F.lit("skipped_records").alias("metric"), F.col("record_type").alias("key"))
        .agg(F.count("*").alias("value"))
        .unionByName(events.groupBy("session_key", F.lit("unknown_events").alias("metric"), F.lit("").alias("key")).agg(F.count_if(F.col("kind") == "unknown").alias("value")))
        .unionByName(tool_totals(events).select("session_key", F.lit("orphan_results").alias("metric"), F.lit("").alias("key"), F.col("orphan_results").alias("value")))
    )


def prompt_tokens(harness, input_tokens, cache_read, cache_creation):
    """Prompt tokens that were processed: some providers count cached ones within input, others beside it."""
    zero = F.lit(0)
    return F.when(harness == "claude-code", F.coalesce(input_tokens, zero) + F.coalesce(cache_read, zero) + F.coalesce(cache_creation, zero)).otherwise(F.coalesce(input_tokens, zero))


def side_by_side(stats: DataFrame) -> DataFrame:
    """Sums by agent tool over session statistics that have a ``harness`` column."""
    return stats.groupBy("harness").agg(
        F.count("*").alias("sessions"),
        F.sum("events").alias("events"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("tool_time_ms").alias("tool_time_ms"),
        F.sum(prompt_tokens(F.col("harness"), F.col("input_tokens"), F.col("cache_read_input_tokens"), F.col("cache_creation_input_tokens"))).alias("prompt_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )


def fetch_compression(events: DataFrame) -> DataFrame:
    """(session_key, fetches, content_bytes, raw_bytes, per_myriad): what fetch results kept of what was fetched."""
    got = events.where("tool_result.fetch is not null").select("session_key", content_bytes(F.col("tool_result.content")).alias("kept"), F.coalesce("tool_result.fetch.raw_bytes", F.lit(0)).alias("raw"))
    out = got.groupBy("session_key").agg(F.count("*").alias("fetches"), F.sum("kept").alias("content_bytes"), F.sum("raw").alias("raw_bytes"))
    return out.withColumn("per_myriad", F.floor(F.try_divide(F.col("content_bytes") * 10000, F.col("raw_bytes"))).cast("long"))
