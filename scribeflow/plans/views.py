"""Transcripts as SQL views: ``events``, ``interactions``, ``stats`` and ``skips``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.interactions import tool_interactions
from ..operators.stats import session_stats
from ..sources.splits import numbered_splits
from ..sources.transcripts import Options, Parsed, parse

VIEWS = ("events", "interactions", "stats", "skips")


def create_views(spark: SparkSession, found: Parsed, prefix: str = "") -> None:
    """Views of parsed transcripts, each name after ``prefix``; nothing is read before a query asks for it."""
    found.events.createOrReplaceTempView(f"{prefix}events")
    tool_interactions(found.events).createOrReplaceTempView(f"{prefix}interactions")
    session_stats(found.events).createOrReplaceTempView(f"{prefix}stats")
    found.skips.createOrReplaceTempView(f"{prefix}skips")


def views_of_folder(spark: SparkSession, harness: str, *paths: str, options: Options = Options(permissive=True), prefix: str = "") -> None:
    """The same over transcript files of one format and the files below folders."""
    create_views(spark, parse(numbered_splits(spark, *paths), harness, options), prefix)
