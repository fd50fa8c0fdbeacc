"""Baselines for drift scans: what the decoders know, and vocabularies made from files and merged over runs.

A baseline made from files has a row for each type, key and value with the first and the last version it was seen in.
Merging is a union that keeps the earliest and the latest version, so that runs over parts of a corpus, or over
years, add up in any order. The library's own baseline has record types and discriminator values only: keys are
told from those of files that are known to be good, and a scan judges keys only where its baseline has some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import LAST_VALIDATED
from ..sources import decode, discover
from ..sources.splits import numbered_splits
from ..sources.transcripts import decoded
from .drift import vocabulary

_CALLS = ("function_call", "custom_tool_call", "local_shell_call", "web_search_call")
#: Values of each discriminator: (record type, path) to names.
_VALUES: dict[str, dict[tuple[str, str], tuple[str, ...]]] = {
    "claude-code": {
        ("assistant", "message.content[].type"): ("text", "thinking", "tool_use", "fallback"),
        ("assistant", "message.content[].name"): (*decode.TOOL_KINDS["claude-code"], "mcp__*"),
        ("user", "message.content[].type"): ("text", "image", "document", "tool_result"),
    },
    "codex": {
        ("event_msg", "payload.type"): (*decode.CODEX_SKIP, "token_count", "task_started", "task_complete", "error", "stream_error", "patch_apply_end", "web_search_end"),
        ("response_item", "payload.type"): ("message", "reasoning", *_CALLS, "function_call_output", "custom_tool_call_output"),
        ("response_item", "payload.name"): tuple(decode.TOOL_KINDS["codex"]),
    },
    "antigravity": {
        (kind, path): names
        for kind in (*decode.ANTIGRAVITY_DISPATCH, *decode.ANTIGRAVITY_RESULTS, *decode.ANTIGRAVITY_AMBIGUOUS)
        for path, names in (("source", decode.ANTIGRAVITY_SOURCES), ("tool_calls[].name", tuple(decode.TOOL_KINDS["antigravity"])))
    },
}


#: Record types of each format.
_TYPES = {
    "claude-code": ("user", "assistant", "system", "attachment", *decode.CLAUDE_SKIP),
    "codex": tuple(decode.CODEX_RECORDS),
    "antigravity": (*decode.ANTIGRAVITY_DISPATCH, *decode.ANTIGRAVITY_RESULTS, *decode.ANTIGRAVITY_AMBIGUOUS),
}
ROW = ("harness", "record_type", "facet", "path", "value")


def shipped(spark: SparkSession) -> DataFrame:
    """Record types and values of every format; its versions are those of ``LAST_VALIDATED``."""
    rows = []
    for harness in LAST_VALIDATED:
        rows += [(harness, kind, "type", "", "") for kind in _TYPES[harness]]
        for (kind, path), names in _VALUES[harness].items():
            rows += [(harness, kind, "value", path, n) for n in names]
    return spark.createDataFrame(rows, "harness string, record_type string, facet string, path string, value string")


def version_place(version: Column) -> Column:
    """Dotted versions in order: their numbers, segment by segment; none comes first."""
    return F.transform(F.split(F.coalesce(version, F.lit("")), r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\d+", 0).try_cast("long"), F.lit(-1)))


def from_lines(lines: DataFrame, harness: str) -> DataFrame:
    """The vocabulary of transcripts' lines (session_key, line, text) with first_version and last_version."""
    rows = decoded(lines, harness)
    version = F.coalesce("version", "meta.harness_version")
    versions = rows.where(version.isNotNull()).groupBy("session_key").agg(F.min_by(version, "line").alias("v"))
    words = vocabulary(lines, harness, "session_key").join(versions, "session_key", "left")
    return merged(words.select(*ROW, F.col("v").alias("first_version"), F.col("v").alias("last_version")))


def merged(*baselines: DataFrame) -> DataFrame:
    """The union of baselines: every row once, with the earliest and the latest version of all."""
    out = None
    for b in baselines:
        for c in ("first_version", "last_version"):
            if c not in b.columns:
                b = b.withColumn(c, F.lit(None).cast("string"))
        b = b.select(*ROW, "first_version", "last_version")
        out = b if out is None else out.unionByName(b)
    first, last = F.col("first_version"), F.col("last_version")
    return out.groupBy(*ROW).agg(F.min_by(first, F.when(first.isNotNull(), version_place(first))).alias("first_version"), F.max_by(last, F.when(last.isNotNull(), version_place(last))).alias("last_version"))


def from_root(spark: SparkSession, root: str, harness: str) -> DataFrame:
    """The baseline of the sessions that discovery finds below a root, subagents too."""
    refs = discover.scan(spark, root, harness).refs
    names = [r["path"] for r in refs.select(F.explode(F.concat(F.array("path"), "subagent_paths")).alias("path")).distinct().toLocalIterator()]
    if not names:
        raise ValueError(f"{harness}: no transcripts under {root}")
    return from_lines(numbered_splits(spark, *names), harness)
