"""Following transcripts as they grow, and activity windows over the event table.

Transcripts grow in place, and a line's meaning depends on lines before it, so a file that is new or has
changed is parsed as a whole and replaces what the sink held of it. A stream's clock drives the passes: Spark's
own file source never looks at a path again. Windowed activity with a watermark runs on any streaming event table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.schema import EVENTS
from ..sources.discover import list_files
from ..sources.lines import raw_lines
from ..sources.transcripts import Options, parse

_FILES = "path string, mtime_us long, length long, pass long"


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _seen(spark: SparkSession, sink: str) -> DataFrame:
    """(path, mtime_us, length, pass): each file as it was when it was last parsed."""
    files = _table(spark, f"{sink}/files", _FILES)
    return files.groupBy("path").agg(F.max_by(F.struct("mtime_us", "length", "pass"), "pass").alias("x")).select("path", "x.*")


def catch_up(spark: SparkSession, root: str, harness: str, sink: str, options: Options = Options(permissive=True), number: int | None = None) -> DataFrame:
    """Parses the files below ``root`` that are new or have changed since the last pass; their (path, mtime_us, length).

    A pass writes its events first and what it read last; a pass that runs again under its number
    overwrites its own folders, so that a failure in between costs a repetition and counts nothing twice.
    """
    known = _seen(spark, sink)
    number = (known.agg(F.max("pass")).first()[0] or 0) + 1 if number is None else number
    files = list_files(spark, root).where("path like '%.jsonl'").select("path", "mtime_us", "length")
    fresh = files.join(known.where(F.col("pass") < number).select("path", "mtime_us", "length"), ["path", "mtime_us", "length"], "left_anti")
    rows = fresh.collect()  # names of changed files, not their contents
    fresh = spark.createDataFrame(rows, files.schema)
    if rows:
        events = parse(raw_lines(spark, *(r["path"] for r in rows)), harness, options).events
        events.write.mode("overwrite").parquet(f"{sink}/events/pass={number}")
        fresh.withColumn("pass", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink}/files/of={number}")
    return fresh


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The event table of all files as last parsed."""
    plain = lambda c: F.regexp_replace(c, r"^file:/*", "/")
    latest = _seen(spark, sink).select(plain("path").alias("_path"), F.col("pass").alias("_pass"))
    events = _table(spark, f"{sink}/events", StructType([*EVENTS.fields, StructField("pass", LongType())]))
    kept = events.join(latest, (plain("session_key") == F.col("_path")) & (F.col("pass") == F.col("_pass")), "left_semi")
    return kept.drop("pass")


def follow(spark: SparkSession, root: str, harness: str, sink: str, checkpoint: str, options: Options = Options(permissive=True), after: Callable[[DataFrame, int], None] | None = None, every: str = "30 seconds") -> StreamingQuery:
    """A query that catches up with ``root`` at every tick; ``after`` gets the changed files and the pass's number."""

    def tick(rows: DataFrame, number: int) -> None:
        fresh = catch_up(rows.sparkSession, root, harness, sink, options, number + 1)
        if after:
            after(fresh, number + 1)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def activity(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events and tool calls by session-independent time window; rows later than ``late`` are dropped.

    ``events`` has ts_us and kind, and may be a stream or a batch.
    """
    rows = events.where("ts_us is not null").select(F.timestamp_micros("ts_us").alias("ts"), "kind").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "tool_call").alias("tool_calls")).select("w.start", "w.end", "events", "tool_calls")
