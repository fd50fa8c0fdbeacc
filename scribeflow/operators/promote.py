"""Opt-in promotion of telemetry events to tool calls with their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import CALL, RESULT


def _promote(events: DataFrame, subtype: str, tool: str, kind: str, origin: str, input_key: str, fails: bool) -> DataFrame:
    """Replaces ``system`` events of a subtype by a call and a result; other events pass unchanged."""
    details = F.col("system.details")
    field = lambda k: F.get_json_object(details, f"$.{k}")
    hit = F.coalesce((F.col("kind") == "system") & (F.col("system.subtype") == subtype), F.lit(False))
    ident = F.coalesce(F.nullif(field("call_id"), F.lit("")), F.concat(F.lit(f"{subtype}:L"), F.col("line").cast("string")))
    call = F.struct(ident.alias("tool_call_id"), F.lit(tool).alias("name"), F.lit(kind).alias("kind"), field(input_key).alias("input"), F.lit(origin).alias("promoted_from")).cast(CALL)
    failed = (field("success") == "false") if fails else F.lit(False)
    result = F.struct(
        ident.alias("tool_call_id"),
        F.lit(tool).alias("tool_name"),
        F.coalesce(failed, F.lit(False)).alias("is_error"),
        F.lit(None).cast(RESULT["content"].dataType).alias("content"),
        F.lit(None).cast(RESULT["fetch"].dataType).alias("fetch"),
        details.alias("enrichment"),
        F.lit(origin).alias("promoted_from"),
    )
    parts = events.withColumn("_hit", hit).withColumn("_part", F.explode(F.when(hit, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    new = F.col("_part")
    out = (
        parts.withColumn("kind", F.when(new == 1, "tool_call").when(new == 2, "tool_result").otherwise(F.col("kind")))
        .withColumn("tool_call", F.when(new == 1, call).when(new == 0, F.col("tool_call")))
        .withColumn("tool_result", F.when(new == 2, result).when(new == 0, F.col("tool_result")))
        .withColumn("system", F.when(new == 0, F.col("system")))
        .withColumn("id", F.when(new == 0, F.col("id")))
        .withColumn("parent_id", F.when(new == 0, F.col("parent_id")))
    )
    order = Window.partitionBy("session_key").orderBy("seq", "_part")
    return out.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).select(*events.columns)


def promote_web_search(events: DataFrame) -> DataFrame:
    return _promote(events, "web_search_end", "web_search", "fetch", "event_msg/web_search_end", "action", fails=False)


def promote_patch_apply(events: DataFrame) -> DataFrame:
    return _promote(events, "patch_apply_end", "apply_patch", "edit", "event_msg/patch_apply_end", "changes", fails=True)


#: Promotions by name, and the agent tool that each belongs to.
PROMOTIONS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "codex:patch-apply": ("codex", promote_patch_apply),
    "codex:web-search": ("codex", promote_web_search),
}


def resolve(names: list[str], harness: str) -> list[Callable[[DataFrame], DataFrame]]:
    """The named promotions; an unknown name or one of another agent tool is an error."""
    out = []
    for name in names:
        if name not in PROMOTIONS:
            raise ValueError(f"unknown promotion {name!r}; known: {', '.join(sorted(PROMOTIONS))}")
        owner, fn = PROMOTIONS[name]
        if owner != harness:
            raise ValueError(f"promotion {name!r} applies to {owner} transcripts, not {harness}")
        out.append(fn)
    return out
