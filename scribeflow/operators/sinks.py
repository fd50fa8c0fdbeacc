"""Output forms: sessions as JSON, events as JSON lines, statistics, references, update messages, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import PAYLOADS, SCHEMA_VERSION
from . import stats


def _event() -> list:
    time = F.when(F.col("ts_us").isNotNull(), F.concat(F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    provenance = F.when(F.col("line").isNotNull(), F.struct("line", "end_line", "raw"))
    names = {"meta": "session_meta"}
    return [F.col("kind"), time.alias("timestamp"), F.col("id"), F.col("parent_id"), F.col("message_id"), provenance.alias("provenance"), *(F.col(p).alias(names.get(p, p)) for p in PAYLOADS)]


def events_jsonl(events: DataFrame) -> DataFrame:
    """(session_key, seq, value): one JSON object for each event; empty fields are left out."""
    return events.select("session_key", "seq", F.to_json(F.struct(*_event())).alias("value"))


def sessions_json(events: DataFrame, pretty: bool = True) -> DataFrame:
    """(session_key, value): each session as one document; a session is one output value."""
    rows = events.select("session_key", "seq", F.struct(*_event()).alias("e"))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    grouped = rows.groupBy("session_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e")), by_seq), lambda x: x["e"]).alias("events"))
    total = stats.session_counts(events).select("session_key", F.when(F.col("input_tokens").isNotNull(), F.struct("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")).alias("totals"))
    doc = F.struct(F.lit(SCHEMA_VERSION).alias("schema"), F.get("events", F.lit(0))["session_meta"].alias("meta"), F.col("totals"), F.col("events"))
    return grouped.join(total, "session_key").select("session_key", F.to_json(doc, {"pretty": str(pretty).lower()}).alias("value"))


def stats_json(events: DataFrame) -> DataFrame:
    """(session_key, value): the wide figures and, by key, the long ones."""
    long = stats.long_stats(events).groupBy("session_key", "metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    maps = long.groupBy("session_key").agg(F.map_from_entries(F.collect_list(F.struct("metric", "m"))).alias("by"))
    models = stats.models_observed(events).groupBy("session_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("model_ord", "model"))), lambda x: x["model"]).alias("models"))
    wide = stats.session_stats(events)
    names = [c for c in wide.columns if c != "session_key"]
    joined = wide.join(maps, "session_key", "left").join(models, "session_key", "left")
    keyed = ("event_counts", "tool_calls_by_name", "tool_calls_by_kind", "result_bytes_by_name", "tool_time_ms_by_name", "system_by_subtype")
    return joined.select("session_key", F.to_json(F.struct(*names, "models", *(F.element_at("by", k).alias(k) for k in keyed))).alias("value"))


def skip_summary(events: int, skips: dict[str, int]) -> str:
    """``N events, M skipped records (type n, ...)`` with the types sorted."""
    total = sum(skips.values())
    word = lambda n, w: f"{n} {w}" if n == 1 else f"{n} {w}s"
    detail = f" ({', '.join(f'{k} {v}' for k, v in sorted(skips.items()))})" if skips else ""
    return f"{word(events, 'event')}, {word(total, 'skipped record')}{detail}"


def ref_paths(refs: DataFrame) -> DataFrame:
    """Transcript paths, each session's own before its subagents'."""
    rows = refs.select("path", F.posexplode(F.concat(F.array("path"), "subagent_paths")).alias("n", "value"))
    return rows.orderBy("path", "n").select("value")


def acp_json(updates: DataFrame) -> DataFrame:
    """(session_key, seq, block_idx, value): update messages with their wire names."""
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    chunk = F.to_json(F.struct(F.col("update").alias("sessionUpdate"), text.alias("content")))
    call = F.to_json(F.struct(F.col("update").alias("sessionUpdate"), F.col("tool_call_id").alias("toolCallId"), "title", F.col("tool_kind").alias("kind"), "status", F.try_parse_json("raw_input").alias("rawInput")))
    content = F.when(F.coalesce("text", F.lit("")) != "", F.array(F.struct(F.lit("content").alias("type"), text.alias("content"))))
    result = F.to_json(F.struct(F.col("update").alias("sessionUpdate"), F.col("tool_call_id").alias("toolCallId"), "status", content.alias("content"), F.try_parse_json("raw_output").alias("rawOutput")))
    value = F.when(F.col("update") == "tool_call", call).when(F.col("update") == "tool_call_update", result).otherwise(chunk)
    return updates.select("session_key", "seq", "block_idx", value.alias("value"))


def baseline_json(vocabulary: DataFrame, version: str) -> DataFrame:
    """One baseline document for each format: record types with sorted keys and discriminator values."""
    keys = vocabulary.where("facet = 'key'").groupBy("harness", "record_type").agg(F.array_sort(F.collect_set("value")).alias("keys"))
    values = vocabulary.where("facet = 'value'").groupBy("harness", "record_type", "path").agg(F.array_sort(F.collect_set("value")).alias("v"))
    values = values.groupBy("harness", "record_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "v")))).alias("discriminators"))
    types = vocabulary.where("facet = 'type'").select("harness", "record_type").join(keys, ["harness", "record_type"], "left").join(values, ["harness", "record_type"], "left")
    by_name = lambda a, b: F.when(a["record_type"] < b["record_type"], -1).when(a["record_type"] > b["record_type"], 1).otherwise(0)
    both = types.groupBy("harness").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_type", F.struct("keys", "discriminators").alias("vocabulary"))), by_name)).alias("record_types"))
    return both.select("harness", F.to_json(F.struct("harness", F.lit(version).alias("generated_from_version"), "record_types"), {"pretty": "true"}).alias("value"))


def read_baseline(text: str, spark) -> DataFrame:
    """A baseline document as vocabulary rows."""
    schema = "harness string, record_types map<string,struct<keys:array<string>,discriminators:map<string,array<string>>>>"
    doc = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", schema).alias("d"))
    types = doc.select("d.harness", F.explode("d.record_types").alias("record_type", "t"))
    a = types.select("harness", "record_type", F.lit("type").alias("facet"), F.lit("").alias("path"), F.lit("").alias("value"))
    b = types.select("harness", "record_type", F.lit("key").alias("facet"), F.lit("").alias("path"), F.explode("t.keys").alias("value"))
    c = types.select("harness", "record_type", F.explode("t.discriminators").alias("path", "v")).select("harness", "record_type", F.lit("value").alias("facet"), "path", F.explode("v").alias("value"))
    return a.unionByName(b).unionByName(c)
