"""Projection onto session-update messages, with a report of what the projection loses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chunks(kind: str, blocks: Column) -> Column:
    """Updates for the non-empty text blocks that were not cut."""
    ok = F.filter(blocks, lambda b: (b["kind"] == "text") & (F.coalesce(b["text"], F.lit("")) != "") & ~F.coalesce(b["truncated"], F.lit(False)))
    return F.coalesce(F.transform(ok, lambda b: F.struct(F.lit(kind).alias("update"), b["text"].alias("text"))), _none())


def _none() -> Column:
    return F.array().cast("array<struct<update:string,text:string>>")


def _block_losses(blocks: Column) -> Column:
    """A block that was cut counts as such; empty text counts as nothing; other kinds by their name."""
    lost = F.transform(
        blocks,
        lambda b: F.when(F.coalesce(b["truncated"], F.lit(False)), F.lit("content_block:truncated"))
        .when(b["kind"] != "text", F.concat(F.lit("content_block:"), b["kind"]))
        .otherwise(F.lit(None).cast("string")),
    )
    return F.coalesce(F.filter(lost, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _has(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) != ""


def _projected(events: DataFrame) -> DataFrame:
    kind = F.col("kind")
    user, said = _chunks("user_message_chunk", F.col("user_message.content")), _chunks("agent_message_chunk", F.col("assistant_message.content"))
    thought = F.when(_has("thinking.text"), F.array(F.struct(F.lit("agent_thought_chunk").alias("update"), F.col("thinking.text").alias("text")))).otherwise(_none())
    one = lambda name: F.array(F.struct(F.lit(name).alias("update"), F.lit(None).cast("string").alias("text")))
    updates = (
        F.when(kind == "user_message", user)
        .when(kind == "assistant_message", said)
        .when(kind == "thinking", thought)
        .when(kind == "tool_call", one("tool_call"))
        .when(kind == "tool_result", one("tool_call_update"))
        .otherwise(_none())
    )
    return events.withColumn("updates", updates)


def acp_updates(events: DataFrame) -> DataFrame:
    """One row for each update: session_key, seq, block_idx, update, text, tool_call_id, title, tool_kind, status, raw_input, raw_output.

    A tool result's text is its text blocks that were kept, joined by line breaks.
    """
    rows = _projected(events).select("session_key", "seq", "tool_call", "tool_result", F.posexplode("updates").alias("block_idx", "u"))
    is_call, is_result = F.col("u.update") == "tool_call", F.col("u.update") == "tool_call_update"
    text = F.array_join(F.transform(_chunks("", F.col("tool_result.content")), lambda c: c["text"]), "\n")
    failed = F.coalesce(F.col("tool_result.is_error"), F.lit(False))
    return rows.select(
        "session_key",
        "seq",
        F.col("block_idx").cast("long").alias("block_idx"),
        F.col("u.update").alias("update"),
        F.when(is_result, text).otherwise(F.col("u.text")).alias("text"),
        F.coalesce("tool_call.tool_call_id", "tool_result.tool_call_id").alias("tool_call_id"),
        F.col("tool_call.name").alias("title"),
        F.col("tool_call.kind").alias("tool_kind"),
        F.when(is_call, "pending").when(is_result & failed, "failed").when(is_result, "completed").alias("status"),
        F.col("tool_call.input").alias("raw_input"),
        F.col("tool_result.enrichment").alias("raw_output"),
    )


def _losses(events: DataFrame) -> DataFrame:
    kind = F.col("kind")
    is_kind = lambda k: kind == k
    when = lambda cond, name: F.when(cond, F.lit(name))
    none = F.size("updates") == 0
    dropped = F.array_compact(
        F.array(
            when(is_kind("session_meta"), "session_meta"),
            when(is_kind("user_message") & none, "user_message_empty"),
            when(is_kind("assistant_message") & none, "assistant_message_empty"),
            when(is_kind("thinking") & none, "thinking_empty"),
            F.when(is_kind("system"), F.concat(F.lit("system/"), F.coalesce("system.subtype", F.lit("")))),
            when(is_kind("unknown"), "unknown"),
        )
    )
    fields = F.array_compact(
        F.array(
            when(F.col("ts_us").isNotNull(), "timestamp"),
            when(is_kind("user_message") & (F.col("user_message.origin") == "harness"), "user_message.origin"),
            when(is_kind("assistant_message") & _has("assistant_message.model"), "assistant_message.model"),
            when(is_kind("assistant_message") & _has("assistant_message.stop_reason"), "assistant_message.stop_reason"),
            when(is_kind("assistant_message") & F.col("assistant_message.usage").isNotNull(), "assistant_message.usage"),
            when(is_kind("thinking") & _has("thinking.signature"), "thinking.signature"),
            when(is_kind("tool_result") & F.col("tool_result.fetch").isNotNull(), "tool_result.fetch"),
        )
    )
    blocks = F.coalesce(F.col("user_message.content"), F.col("assistant_message.content"), F.col("tool_result.content"))
    return _projected(events).select("session_key", "updates", dropped.alias("dropped"), F.concat(fields, _block_losses(blocks)).alias("fields"))


def acp_loss(events: DataFrame) -> DataFrame:
    """(session_key, loss_type, key, value): totals, dropped events by reason, dropped fields by name."""
    lost = _losses(events)
    n = F.size("updates")
    totals = lost.groupBy("session_key").agg(F.count("*").alias("total_events"), F.count_if(n > 0).alias("projected_events"), F.sum(n).alias("updates"))
    totals = totals.unpivot(["session_key"], ["total_events", "projected_events", "updates"], "key", "value").withColumn("loss_type", F.lit("totals"))
    part = lambda c, name: lost.select("session_key", F.explode(c).alias("key")).groupBy("session_key", "key").agg(F.count("*").alias("value")).withColumn("loss_type", F.lit(name))
    out = totals.unionByName(part("dropped", "dropped_events")).unionByName(part("fields", "dropped_fields"))
    return out.select("session_key", "loss_type", "key", F.col("value").cast("long").alias("value"))
