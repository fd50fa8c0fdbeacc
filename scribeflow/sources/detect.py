"""Which format a transcript has, by its first line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decode
from .lines import SNIFF_BYTES

#: In order; the first of equal confidence wins.
REGISTRY = ("antigravity", "claude-code", "codex")
CONFIDENCE = {0: "no-match", 1: "possible", 2: "certain"}

_PROBE = "type string, sessionId string, uuid string, timestamp string, step_index long, source string, payload struct<id:string,session_id:string,cli_version:string>"


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def probed(first: DataFrame) -> DataFrame:
    """First lines with ``_head``, ``_ok`` and ``_p``, which ``confidences`` looks at: columns, so that each is made once for a line."""
    head = F.substring(F.col("text").cast("binary"), 1, SNIFF_BYTES).cast("string")
    rows = first.withColumn("_head", head)
    # try_parse_json tells malformed lines; the probe reads the few fields that matter.
    whole = F.when(F.octet_length("text") <= SNIFF_BYTES, F.col("text"))
    rows = rows.withColumn("_ok", F.coalesce(F.try_parse_json(whole).isNotNull() & F.col("_head").startswith("{"), F.lit(False)))
    return rows.withColumn("_p", F.from_json(F.when(F.col("_ok"), F.col("text")), _PROBE))


def confidences() -> dict[str, Column]:
    """Confidence 0 to 2 of each format, from a ``probed`` first line as far as it is looked at."""
    head, ok, p = F.col("_head"), F.col("_ok"), F.col("_p")
    has = lambda *marks: [head.contains(f'"{m}"') for m in marks]

    def every(conditions: list[Column]) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & c
        return out

    kind, conversation, skip = p["type"], p["type"].isin(*decode.CLAUDE_CONVERSATION), p["type"].isin(*decode.CLAUDE_SKIP)
    claude = (
        F.when(~ok, every(has("parentUuid", "sessionId")).cast("int"))
        .when(conversation & _some(p["sessionId"]) & _some(p["uuid"]), 2)
        .when(skip & (_some(p["sessionId"]) | kind.isin("file-history-snapshot", "file-history-delta")), 2)
        .when(conversation | skip | kind.isin(*decode.CLAUDE_LEGACY), 1)
        .when(_some(kind) & (_some(p["sessionId"]) | head.contains('"parentUuid"') | head.contains('"leafUuid"')), 1)
        .otherwise(0)
    )
    codex = (
        F.when(~ok, every(has("payload", "cli_version")).cast("int"))
        .when((kind == "session_meta") & (_some(p["payload"]["session_id"]) | _some(p["payload"]["id"])) & _some(p["payload"]["cli_version"]), 2)
        .when(kind.isin(*decode.CODEX_RECORDS) & _some(p["timestamp"]), 1)
        .otherwise(0)
    )
    known = (*decode.ANTIGRAVITY_DISPATCH, *decode.ANTIGRAVITY_RESULTS, *decode.ANTIGRAVITY_AMBIGUOUS)
    step = p["step_index"].isNotNull()
    antigravity = (
        F.when(~ok, every(has("step_index", "source", "created_at")).cast("int"))
        .when(step & p["source"].isin(*decode.ANTIGRAVITY_SOURCES) & kind.isin(*known), 2)
        .when(step & _some(p["source"]) & _some(kind), 1)
        .otherwise(0)
    )
    return {"antigravity": antigravity, "claude-code": claude, "codex": codex}


def detect(lines: DataFrame) -> DataFrame:
    """(session_key, harness, confidence): the most confident format, NULL where none matches.

    The header is the file's first line, so a blank one matches nothing.
    """
    first = probed(lines.where("line = 1"))
    found = confidences()
    best = F.greatest(*found.values())
    name = F.lit(None).cast("string")
    for h in reversed(REGISTRY):
        name = F.when(found[h] == best, F.lit(h)).otherwise(name)
    keys = lines.select("session_key").distinct()
    chosen = first.select("session_key", F.when(best > 0, name).alias("harness"), best.alias("_c"))
    words = F.element_at(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv)), F.coalesce("_c", F.lit(0)))
    return keys.join(chosen, "session_key", "left").select("session_key", "harness", words.alias("confidence"))
