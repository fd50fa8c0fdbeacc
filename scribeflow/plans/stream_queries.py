"""Queries whose rows pass through files and streams, beside the SQL of the batch parser's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import gaps
from ..sources.splits import numbered_splits
from ..sources.transcripts import Options, dealt, parse
from ..streaming.incremental import follow_log, new_bytes, standing
from .bridge import event_sessions
from .native import flat, parsed, rich_lines, tasks_of
from .native_queries import ORACLES as ORACLES_NATIVE
from .native_sql import WITH
from .scratch import folder
from .session_files import write_sessions
from .views import create_views

QUERIES: dict = {}
ORACLES: dict = {}


def transcript_files(spark: SparkSession, sf_dir: str, harness: str) -> str:
    """A new folder with each user's transcript as a file of its own, ``deal=N/session_key=NAME/part-0.txt``."""
    root = f"{folder(spark)}/transcripts-{uuid.uuid4().hex}"
    write_sessions(dealt(rich_lines(spark, sf_dir, harness), tasks_of(spark, sf_dir)).sortWithinPartitions("session_key", "line"), root)
    return root


def by_name(df: DataFrame) -> DataFrame:
    """Session keys are the names in the paths."""
    return df.withColumn("session_key", F.regexp_extract("session_key", "session_key=([^/]+)/", 1))


def _followed(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    """Each user's transcript, followed by a stream in pieces of 64 KB."""
    root, base = transcript_files(spark, sf_dir, harness), f"{folder(spark)}/follow-{uuid.uuid4().hex}"
    options = Options(permissive=True)
    follow_log(new_bytes(spark, root, ".txt", pieceBytes=65_536), harness, f"{base}/log", f"{base}/checkpoint", options).awaitTermination()
    return flat(by_name(standing(spark, f"{base}/log", harness, options).events))


def _split(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    """Each user's transcript, numbered by splits of 16 KB."""
    lines = by_name(numbered_splits(spark, transcript_files(spark, sf_dir, harness), split=16_384, suffix=".txt"))
    return flat(parse(lines, harness, Options(permissive=True, tasks=tasks_of(spark, sf_dir))).events)


def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over the views of the event table."""
    create_views(spark, parsed(spark, sf_dir, "claude-code"), "sql_views_")
    return spark.sql("SELECT session_key, tool_calls, tool_errors, fetch_raw_bytes, result_bytes FROM sql_views_stats WHERE session_key IN (SELECT session_key FROM sql_views_interactions)")


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that no event or skip accounts for; results cover three lines, every fifth call one, messages one."""
    e = event_sessions(spark, sf_dir).where("seq % 3 <> 1")
    events = e.where("kind <> 'tool_call'").withColumn("end_line", F.when(F.col("kind") == "tool_result", F.col("line") + 2).otherwise(F.col("line")))
    return gaps(events, e.where("kind = 'tool_call' and seq % 5 = 0").select("session_key", "line")).select("session_key", *(F.col(c).cast("long").alias(c) for c in ("first", "last")))


QUERIES["sql_views"], ORACLES["sql_views"] = sql_views, ORACLES_NATIVE["native_tool_totals"]
QUERIES["line_gaps"] = line_gaps
for _h, _name in (("claude-code", "claude"), ("codex", "codex")):
    QUERIES[f"split_events_{_name}"] = lambda spark, d, h=_h: _split(spark, d, h)
    ORACLES[f"split_events_{_name}"] = f"WITH {WITH[_h]} SELECT * FROM flat"
for _h, _name in (("claude-code", "claude"), ("codex", "codex"), ("antigravity", "antigravity")):
    QUERIES[f"stream_events_{_name}"] = lambda spark, d, h=_h: _followed(spark, d, h)
    ORACLES[f"stream_events_{_name}"] = f"WITH {WITH[_h]} SELECT * FROM flat"
