"""Joining tool calls with their results: a backward as-of join done with one window, no shuffle join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN_TOOL = "(unknown)"


def paired(events: DataFrame) -> DataFrame:
    """Calls and results with ``call_seq``: a result's most recent earlier call of the same id, or NULL.

    Events are dealt by session once; windows and groups by session and id reuse that.
    """
    tools = events.where(F.col("kind").isin("tool_call", "tool_result"))
    ident = F.coalesce(F.col("tool_call.tool_call_id"), F.col("tool_result.tool_call_id"))
    tools = tools.withColumn("tool_call_id", ident).withColumn("is_call", F.col("kind") == "tool_call")
    before = Window.partitionBy("session_key", "tool_call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    tools = tools.withColumn("call_seq", F.last(F.when(F.col("is_call"), F.col("seq")), ignorenulls=True).over(before))
    name = F.last(F.col("tool_call.name"), ignorenulls=True).over(before)
    return tools.withColumn("call_name", name)


def tool_interactions(events: DataFrame) -> DataFrame:
    """One row for each call with its results, and for each orphan result; in stream order.

    session_key, seq (of the row that starts the interaction), tool_call_id, has_call, name, call_kind,
    call_ts_us, results (array by seq of seq, ts_us, is_error, bytes, tool_name, fetch_bytes).
    """
    from ..functions.columns import content_bytes

    pairs = paired(events)
    result = F.struct("seq", "ts_us", F.coalesce("tool_result.is_error", F.lit(False)).alias("is_error"), content_bytes(F.col("tool_result.content")).alias("bytes"), F.col("tool_result.tool_name").alias("tool_name"), F.col("tool_result.fetch.raw_bytes").alias("fetch_bytes"))
    grouped = pairs.groupBy("session_key", "tool_call_id", F.coalesce("call_seq", "seq").alias("start_seq")).agg(
        F.max("is_call").alias("has_call"),
        F.max(F.col("tool_call.name")).alias("name"),
        F.max(F.col("tool_call.kind")).alias("call_kind"),
        F.max(F.when(F.col("is_call"), F.col("ts_us"))).alias("call_ts_us"),
        F.array_sort(F.collect_list(F.when(~F.col("is_call"), result))).alias("results"),
    )
    return grouped.select("session_key", F.col("start_seq").alias("seq"), "tool_call_id", "has_call", "name", "call_kind", "call_ts_us", "results")


def tool_names(events: DataFrame, keep: Column | None = None) -> DataFrame:
    """Gives each result the name of the latest earlier call of its id; results with ``keep`` stay as they are."""
    before = Window.partitionBy("session_key", "_ident").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    called = F.last(F.when(F.col("tool_call").isNotNull(), F.coalesce("tool_call.name", F.lit(""))), ignorenulls=True).over(before)
    rows = events.withColumn("_ident", F.coalesce("tool_call.tool_call_id", "tool_result.tool_call_id")).withColumn("_name", F.nullif(called, F.lit("")))
    as_is = F.col("tool_result").isNull() if keep is None else F.col("tool_result").isNull() | keep
    return rows.withColumn("tool_result", F.when(as_is, F.col("tool_result")).otherwise(F.col("tool_result").withField("tool_name", F.col("_name")))).drop("_ident", "_name")
