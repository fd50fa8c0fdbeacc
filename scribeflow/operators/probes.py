"""What a session was expected to show: predicates over events, each naming what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blocks_text
from .stats import interaction_rows


def _missing(events: DataFrame, found: DataFrame, text: Column | str) -> DataFrame:
    """(session_key, missing) of the sessions that ``found`` (session_key, ok) does not clear."""
    sessions = events.select("session_key").distinct().join(found, "session_key", "left")
    return sessions.where(~F.coalesce("ok", F.lit(False))).select("session_key", (F.lit(text) if isinstance(text, str) else text).alias("missing"))


def missing_answer(events: DataFrame) -> DataFrame:
    """Sessions without an assistant message that has text."""
    said = (F.col("kind") == "assistant_message") & (blocks_text(F.col("assistant_message.content")) != "")
    return _missing(events, events.groupBy("session_key").agg(F.coalesce(F.max(said), F.lit(False)).alias("ok")), "assistant text")


def missing_tool_kind(events: DataFrame, kind: str) -> DataFrame:
    """Sessions without an answered call of a tool kind."""
    hit = F.col("has_call") & (F.col("call_kind") == kind) & (F.col("n_results") > 0)
    return _missing(events, interaction_rows(events).groupBy("session_key").agg(F.coalesce(F.max(hit), F.lit(False)).alias("ok")), f"a {kind} call with its result")


def missing_tools(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sessions without an answered call of each of the named tools; says which are missing."""
    done = interaction_rows(events).where("has_call and n_results > 0").groupBy("session_key").agg(F.collect_set(F.when(F.col("tool").isin(*names), F.col("tool"))).alias("seen"))
    left = F.array_except(F.lit(sorted(names)), F.coalesce("seen", F.array().cast("array<string>")))
    return _missing(events, done.select("session_key", "seen", (F.size(left) == 0).alias("ok")), F.lit("")).join(done, "session_key", "left").select("session_key", F.concat(F.lit("tools: "), F.array_join(left, ", ")).alias("missing"))


def missing_calls(events: DataFrame, least: int) -> DataFrame:
    """Sessions with fewer than ``least`` tool calls."""
    return _missing(events, interaction_rows(events).groupBy("session_key").agg((F.count_if("has_call") >= least).alias("ok")), f"{least} tool calls")


def outcome(events: DataFrame, *missing: DataFrame) -> DataFrame:
    """(session_key, category): ``inconclusive`` where anything expected is missing, else ``clean``."""
    lacks = missing[0].select("session_key")
    for m in missing[1:]:
        lacks = lacks.unionByName(m.select("session_key"))
    sessions = events.select("session_key").distinct().join(lacks.distinct().withColumn("lacks", F.lit(True)), "session_key", "left")
    return sessions.select("session_key", F.when(F.col("lacks"), "inconclusive").otherwise("clean").alias("category"))
