"""Checks of the event table and full accounting of lines and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import KINDS, PAYLOADS


def violations(events: DataFrame) -> DataFrame:
    """(session_key, seq, violation) of events that break the table's rules."""
    n = sum((F.col(p).isNotNull().cast("int") for p in PAYLOADS), F.lit(0))
    match = F.lit(False)
    for kind, payload in KINDS.items():
        match = match | ((F.col("kind") == kind) & F.col(payload).isNotNull())
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unrecognized kind"),
            F.when(n != 1, "not exactly one payload"),
            F.when((n == 1) & ~F.coalesce(match, F.lit(False)), "payload does not match kind"),
            F.when(F.col("tool_call").isNotNull() & empty("tool_call.tool_call_id"), "tool call without id"),
            F.when(F.col("tool_result").isNotNull() & empty("tool_result.tool_call_id"), "tool result without id"),
        )
    )
    rows = events.select("session_key", "seq", F.explode(checks).alias("violation"))
    again = events.where("kind = 'session_meta'").groupBy("session_key").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).where("n > 1")
    return rows.unionByName(again.select("session_key", "seq", F.lit("duplicate session_meta").alias("violation")))


def covered_until(spans: DataFrame) -> DataFrame:
    """(session_key, line, end_line, until) with ``until``: the furthest end of the spans up to each, in order of their starts."""
    up_to = Window.partitionBy("session_key").orderBy("line", "end_line").rowsBetween(Window.unboundedPreceding, 0)
    return spans.select("session_key", "line", "end_line", F.max("end_line").over(up_to).alias("until"))


def uncovered_lines(lines: DataFrame, events: DataFrame, skips: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """(session_key, line) of non-blank lines that no event, skip or problem accounts for.

    A range anti join by a sweep: spans and lines go through one window in order, a span before a line of the same number,
    and a line is covered if a span before it reaches that far. A span is one row, however long.
    """
    spans = events.where("line is not null").select("session_key", "line", F.coalesce("end_line", "line").alias("end_line"))
    single = skips.select("session_key", "line")
    if problems is not None:
        single = single.unionByName(problems.select("session_key", "line"))
    spans = spans.unionByName(single.withColumn("end_line", F.col("line")))
    both = spans.select("session_key", "line", "end_line").unionByName(lines.select("session_key", "line").withColumn("end_line", F.lit(None).cast(spans.schema["end_line"].dataType)))
    up_to = Window.partitionBy("session_key").orderBy("line", F.col("end_line").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_until", F.max("end_line").over(up_to)).where(F.col("end_line").isNull())
    return swept.where(F.col("_until").isNull() | (F.col("_until") < F.col("line"))).select("session_key", "line")


def gaps(events: DataFrame, skips: DataFrame) -> DataFrame:
    """(session_key, first, last): runs of lines between 1 and the last span that nothing covers, a row for each run."""
    spans = events.where("line is not null").select("session_key", "line", F.coalesce("end_line", "line").alias("end_line")).unionByName(skips.select("session_key", "line", F.col("line").alias("end_line")))
    reach = covered_until(spans)
    before = F.coalesce(F.lag("until").over(Window.partitionBy("session_key").orderBy("line", "end_line")), F.lit(0))
    return reach.withColumn("_before", before).where(F.col("line") > F.col("_before") + 1).select("session_key", (F.col("_before") + 1).cast("int").alias("first"), (F.col("line") - 1).alias("last"))


def uncovered_files(files: DataFrame, refs: DataFrame, skips: DataFrame, errors: DataFrame) -> DataFrame:
    """Paths that no reference, subagent list, skip or error accounts for."""
    seen = refs.select("path").unionByName(refs.select(F.explode("subagent_paths").alias("path"))).unionByName(skips.select("path")).unionByName(errors.select("path"))
    return files.select("path").join(seen.distinct(), "path", "left_anti")


def first_claims(claims: DataFrame) -> DataFrame:
    """(path, owner) of files that several probes claim: the first in ``ord`` owns a file."""
    return claims.groupBy("path").agg(F.min_by("owner", F.struct("ord", "owner")).alias("owner"))
