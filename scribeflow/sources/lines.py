"""Numbered lines of transcript files, whatever the splits they are read in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Longest line, and the part of a first line that detection looks at, in bytes.
MAX_LINE_BYTES = 256 * 1024 * 1024
SNIFF_BYTES = 64 * 1024

BOM = "\ufeff"
TRIM = " \t\r\n\v\f"


def numbered(raw: DataFrame) -> DataFrame:
    """(session_key, line, text) from (session_key, block, pos, value): numbered, then trimmed, then non-blank.

    Only line feeds end a line; a byte-order mark in front of line 1 goes; blank lines count but don't stay.
    """
    order = Window.partitionBy("session_key").orderBy("block", "pos")
    lines = raw.withColumn("line", F.row_number().over(order))
    text = F.when(F.col("line") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    lines = lines.select("session_key", "line", F.btrim(text, F.lit(TRIM)).alias("text")).where("text <> ''")
    return lines.withColumn("text", F.when(F.octet_length("text") <= MAX_LINE_BYTES, F.col("text")).otherwise(F.raise_error(F.lit("a line is longer than the limit"))))


def raw_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(session_key, block, pos, value): lines of files, directories or patterns where they are read, not yet numbered.

    The path is the session key. ``parse`` takes these too, and numbers them after decoding, which saves
    dealing the texts once more.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(list(paths))
    return raw.select(F.col("_metadata.file_path").alias("session_key"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Numbered lines of files, directories or patterns; the path is the session key."""
    return numbered(raw_lines(spark, *paths))


def lines_of(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Lines of texts in memory, such as standard input, under given keys."""
    rows = [(k, 0, i, v) for k, t in texts.items() for i, v in enumerate(t.split("\n")) if i < t.count("\n") or v]
    return numbered(spark.createDataFrame(rows, "session_key string, block long, pos long, value string"))
