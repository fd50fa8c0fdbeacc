"""Native transcripts to the normalized event table.

Records are decoded line by line in Arrow batches, which needs no order. One exchange then deals lines by
session, and windows do all that depends on order: folding split messages, attributing token usage,
pairing results with calls, carrying models forward, and numbering events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import LAST_VALIDATED, truncate_block, truncate_json, version_newer
from ..operators.interactions import tool_names
from ..operators.sequence import carry_forward, closing_lines, fifo_match, fold_islands
from ..plans.schema import ASSISTANT, EVENTS, META, PAYLOADS, USAGE
from . import decode
from .lines import BOM, MAX_LINE_BYTES, TRIM

_END = 2**62
_ITEM = T.StructType([f for f in EVENTS.fields if f.name not in ("session_key", "seq", "line", "end_line", "raw")] + [T.StructField("own_name", T.BooleanType())])
_FOLD = T.StructType([T.StructField("message_id", T.StringType()), *(f for f in ASSISTANT.fields)])
_RECORD = T.StructType(
    [
        T.StructField("session_key", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("items", T.ArrayType(_ITEM)),
        T.StructField("skip", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("meta", META),
        T.StructField("sparse", T.BooleanType()),
        T.StructField("version", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("fold", _FOLD),
        T.StructField("opens", T.BooleanType()),
        T.StructField("closes", T.BooleanType()),
        T.StructField("pool", USAGE),
        T.StructField("model", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("takes", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Options:
    """How to read: the same options for every format."""

    permissive: bool = False
    keep_raw: bool = False
    max_payload_bytes: int = 0
    version_hint: str = ""
    #: Tasks that sessions are dealt to; ``spark.sql.shuffle.partitions`` if that is more.
    tasks: int = 0


@dataclass
class Parsed:
    """What came out: events, counted skips, and the errors that end a transcript."""

    events: DataFrame
    skips: DataFrame
    errors: DataFrame
    harness: str
    extra: dict = field(default_factory=dict)


class TranscriptError(ValueError):
    """The first unreadable record of a transcript."""

    def __init__(self, harness: str, version: str | None, line: int, reason: str, newer: bool = False) -> None:
        self.harness, self.version, self.line, self.reason = harness, version, line, reason
        hint = f"; version {version} is newer than the last validated {LAST_VALIDATED[harness]}, so the format may have drifted" if newer else ""
        super().__init__(f"{harness}{f' {version}' if version else ''}: line {line}: {reason}{hint}")


_RAW = T.StructType([*(f for f in _RECORD.fields if f.name != "line"), T.StructField("block", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("marked", T.StringType())])


def _spans(r: dict) -> dict:
    """What a record's errors, skips, versions and the lines of its events depend on."""
    r["items"] = [{"kind": e["kind"]} for e in r["items"]]
    if r.get("fold"):
        r["fold"] = {"message_id": r["fold"].get("message_id")}
    return r | {"text": None, "pool": None}


def decoded(lines: DataFrame, harness: str, spans: bool = False) -> DataFrame:
    """One row for each line with what its decoder says. ``spans``: without texts and what is in the events.

    Raw lines (block, pos, value) keep their places. As their numbers aren't known yet, a byte-order mark in
    front is taken off, and ``marked`` is the problem that the line has if it is not the first.
    """
    raw = "value" in lines.columns
    kind = _RAW if raw else _RECORD
    schema = to_arrow_schema(kind)
    one: Callable[[str, int], dict] = {"claude-code": lambda t, n: decode.claude_code(t), "codex": decode.codex, "antigravity": lambda t, n: decode.antigravity(t)}[harness]

    def place(r: dict) -> dict:
        value = r.pop("value")
        text = value.removeprefix(BOM).strip(TRIM)
        if len(text) > MAX_LINE_BYTES // 4 and len(text.encode("utf-8", "surrogatepass")) > MAX_LINE_BYTES:
            raise ValueError("a line is longer than the limit")
        out = one(text, 0) if text else {"items": []}
        marked = one(value.strip(TRIM), 0)["problem"] if text and value.startswith(BOM) else None
        return out | r | {"text": text, "marked": marked}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000).to_pylist()
                out = (place(r) if raw else one(r["text"], r["line"]) | r for r in rows)
                yield pa.RecordBatch.from_pylist([_spans(r) if spans else r for r in out], schema=schema)

    return lines.select(*(("session_key", "block", "pos", "value") if raw else ("session_key", "line", "text"))).mapInArrow(run, kind)


def _numbered(rows: DataFrame, harness: str) -> DataFrame:
    """Decoded raw lines with their numbers; blank ones count and go."""
    order = Window.partitionBy("session_key").orderBy("block", "pos")
    rows = rows.withColumn("line", F.row_number().over(order)).where("text <> ''")
    late = F.col("marked").isNotNull() & (F.col("line") > 1)
    said = {"items": F.array().cast(T.ArrayType(_ITEM)), "problem": F.col("marked"), "record_type": F.lit(""), "text": F.concat(F.lit(BOM), "text")}
    keep = ("session_key", "line")
    rows = rows.select(*(f.name if f.name in keep else F.when(late, said.get(f.name, F.lit(None).cast(f.dataType))).otherwise(F.col(f.name)).alias(f.name) for f in _RECORD.fields))
    if harness == "codex":  # ids made from a line's number
        made = "web_search_call:L0"
        mend = lambda c: F.when(c["tool_call_id"] == made, c.withField("tool_call_id", F.concat(F.lit("web_search_call:L"), F.col("line").cast("string")))).otherwise(c)
        some = F.exists("items", lambda e: F.coalesce(e["tool_call"]["tool_call_id"] == made, F.lit(False)))
        rows = rows.withColumn("items", F.when(some, F.transform("items", lambda e: e.withField("tool_call", mend(e["tool_call"])).withField("tool_result", mend(e["tool_result"])))).otherwise(F.col("items")))
    return rows


def _nothing(name: str) -> Column:
    return F.lit(None).cast(PAYLOADS[name]).alias(name)


def _made(kind: str, payload: str, value: Column, ts: Column, ident: Column | None = None, parent: Column | None = None, message: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c
    return F.struct(
        F.lit(kind).alias("kind"),
        ts.alias("ts_us"),
        pick(ident).alias("id"),
        pick(parent).alias("parent_id"),
        pick(message).alias("message_id"),
        *(value.cast(PAYLOADS[p]).alias(p) if p == payload else _nothing(p) for p in PAYLOADS),
        F.lit(None).cast("boolean").alias("own_name"),
    )


def _placed(item: Column, major: Column, minor: int, sub: Column, line: Column, end: Column, raw: Column) -> Column:
    return F.struct(major.cast("long").alias("major"), F.lit(minor).alias("minor"), sub.cast("int").alias("sub"), line.alias("line"), end.alias("end_line"), raw.alias("raw"), item.alias("e"))


def _own(options: Options, major: Column) -> Column:
    """A record's own events in order, then its problem as an ``unknown`` event where that is allowed."""
    raw = F.array("text") if options.keep_raw else F.lit(None).cast("array<string>")
    line = F.col("line")
    own = F.transform("items", lambda e, i: _placed(e, major, 1, i, line, line, raw))
    if options.permissive:
        value = F.struct(F.nullif("record_type", F.lit("")).alias("record_type"), F.col("problem").alias("reason"), F.col("text").alias("raw"))
        lost = _placed(_made("unknown", "unknown", value, F.lit(None).cast("long")), major, 1, F.lit(1 << 30), line, line, F.lit(None).cast("array<string>"))
        own = F.concat(own, F.when(F.col("problem").isNotNull(), F.array(lost)).otherwise(F.array()).cast(T.ArrayType(_PLACED)))
    return own


_PLACED = T.StructType(
    [
        T.StructField("major", T.LongType()),
        T.StructField("minor", T.IntegerType()),
        T.StructField("sub", T.IntegerType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("raw", T.ArrayType(T.StringType())),
        T.StructField("e", _ITEM),
    ]
)


def _maybe(condition: Column, placed: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(placed).cast(T.ArrayType(_PLACED))).otherwise(F.array().cast(T.ArrayType(_PLACED)))


def cut_payloads(events: DataFrame, most: int) -> DataFrame:
    """Cuts results' contents that are over ``most`` bytes, where that is set; results that name their own tool stay."""
    if most <= 0:
        return events
    cut = F.col("tool_result").withField("content", F.transform("tool_result.content", lambda b: truncate_block(b, most))).withField("enrichment", truncate_json(F.col("tool_result.enrichment"), most))
    return events.withColumn("tool_result", F.when(F.col("tool_result").isNull() | F.coalesce("_own", F.lit(False)), F.col("tool_result")).otherwise(cut))


def dealt(rows: DataFrame, least: int = 0) -> DataFrame:
    """Rows by session, in as many tasks as the session says or ``least``.

    A number that is given is kept. Without one, small compressed partitions are put together until a task's sorts hold
    many times their size.
    """
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), least), "session_key")


def parse(lines: DataFrame, harness: str, options: Options = Options()) -> Parsed:
    """Events, skips and errors of transcripts in one format. ``lines``: session_key, line, text, or raw or
    ``decoded`` ones.

    A transcript with an error has no events; its first error is reported. Without ``permissive`` a record
    that can't be read is an error; a message resumed after its fold closed always is.
    """
    rows = dealt(lines if "items" in lines.columns else decoded(lines, harness), options.tasks)
    if "pos" in rows.columns:
        rows = _numbered(rows, harness)
    by = Window.partitionBy("session_key")
    rows = carry_forward(rows, "version", "line", "version_so_far")
    raw = F.array("text") if options.keep_raw else F.lit(None).cast("array<string>")
    hint = F.lit(options.version_hint or None).cast("string")
    fatal = F.lit(None).cast("string")
    if harness == "antigravity":
        order = Window.partitionBy("session_key").orderBy(F.col("step").asc_nulls_last(), "line")
        rows = rows.withColumn("ord", F.row_number().over(order))
        rows = carry_forward(rows, "model", "ord", "model_now")
        planner = F.col("names").isNotNull()
        rows = fifo_match(rows, planner, F.col("takes").isNotNull(), F.size("names"), "ord")
        now = by.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_plan", F.last(F.when(planner, F.struct("step", "names")), ignorenulls=True).over(now))
        mid = F.concat(F.lit("step-"), F.col("_plan.step").cast("string"))
        matched = F.col("call_index").isNotNull()
        ident = F.when(matched, F.concat(mid, F.lit(":call-"), F.col("call_index").cast("string"))).otherwise(F.concat(F.lit("step-"), F.col("step").cast("string"), F.lit(":orphan")))
        name = F.when(matched, F.nullif(F.get("_plan.names", F.col("call_index").cast("int")), F.lit("")))
        # A row that may be either is a result while a call is pending, else a system event.
        wanted = F.when((F.col("takes") == "either") & matched, F.filter("items", lambda e: e["kind"] == "tool_result")).when(F.col("takes") == "either", F.filter("items", lambda e: e["kind"] == "system")).otherwise(F.col("items"))
        fixed = F.transform(
            wanted,
            lambda e: F.when(e["kind"] == "tool_result", e.withField("tool_result", e["tool_result"].withField("tool_call_id", ident).withField("tool_name", name)))
            .when(e["kind"] == "assistant_message", e.withField("assistant_message", e["assistant_message"].withField("model", F.col("model_now"))))
            .otherwise(e),
        )
        rows = rows.withColumn("items", fixed)
        major, first = F.col("ord"), F.col("ord") == 1
        meta = F.struct(F.lit("antigravity").alias("harness"), hint.alias("harness_version"), *(F.lit(None).cast(META[c].dataType).alias(c) for c in META.names[2:]))
        extra = _maybe(first, _placed(_made("session_meta", "meta", meta, F.col("ts_us")), major, 0, F.lit(0), F.col("line"), F.col("line"), raw))
    else:
        major = F.col("line")
        eligible = F.col("meta").isNotNull()
        first = eligible & (F.col("line") == F.min(F.when(eligible, F.col("line"))).over(by))
        rows = rows.withColumn("_first", F.coalesce(first, F.lit(False)))
        first = F.col("_first")
        meta = F.col("meta").withField("harness_version", F.coalesce(F.col("meta.harness_version"), hint))
        extra = _maybe(first, _placed(_made("session_meta", "meta", meta, F.col("ts_us")), major, 0, F.lit(0), F.col("line"), F.col("line"), raw))
        if harness == "codex":
            # The leading session_meta became the first event; later ones are system events.
            rows = rows.withColumn("items", F.when(first & ~F.col("sparse"), F.array().cast(T.ArrayType(_ITEM))).otherwise(F.col("items")))
            rows = carry_forward(rows, "model", "line", "model_now")
            rows = closing_lines(rows, F.col("opens"), F.col("closes"), "line")
            owned = Window.partitionBy("session_key", "owner_close")
            any_use = F.max(F.col("pool").isNotNull()).over(owned)
            parts = [F.sum(F.coalesce(F.col(f"pool.{c}"), F.lit(0))).over(owned).alias(c) for c in USAGE.names[:4]]
            rows = rows.withColumn("_usage", F.when(any_use & F.col("owner_close").isNotNull(), F.struct(*parts, F.lit(None).cast("map<string,string>").alias("extra"))))
            value = F.struct(F.col("model_now").alias("model"), F.col("fold.content").alias("content"), F.lit(None).cast("string").alias("stop_reason"), F.col("_usage").alias("usage"))
            anchor = _made("assistant_message", "assistant_message", value, F.col("ts_us"))
            extra = F.concat(extra, _maybe(F.col("opens"), _placed(anchor, F.coalesce("close_line", F.lit(_END)), 0, F.lit(1), F.col("line"), F.col("line"), raw)))
        else:
            folds = F.col("fold").isNotNull()
            # Only rows of assistant messages open, extend or close a fold.
            rows = fold_islands(rows.withColumn("_mid", F.when(folds, F.col("fold.message_id"))), "_mid", "line", folds)
            rows = rows.withColumnsRenamed({"island": "_island", "opens_island": "_new"})
            whole = Window.partitionBy("session_key", "_island").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            later = by.orderBy("line").rowsBetween(1, Window.unboundedFollowing)
            value = F.struct(
                F.col("fold.model").alias("model"),
                F.flatten(F.collect_list("fold.content").over(whole)).alias("content"),
                F.last("fold.stop_reason", ignorenulls=True).over(whole).alias("stop_reason"),
                F.last("fold.usage", ignorenulls=True).over(whole).alias("usage"),
            )
            rows = rows.withColumn("_value", F.when(F.col("_new"), value)).withColumn("_last", F.max("line").over(whole)).withColumn("_close", F.min(F.when(F.col("_new"), F.col("line"))).over(later))
            if options.keep_raw:
                rows = rows.withColumn("_raw", F.collect_list("text").over(whole))
            anchor = _made("assistant_message", "assistant_message", F.col("_value"), F.col("ts_us"), F.nullif("uuid", F.lit("")), F.nullif("parent", F.lit("")), F.col("_mid"))
            held = F.col("_raw") if options.keep_raw else raw
            extra = F.concat(extra, _maybe(F.col("_new"), _placed(anchor, F.coalesce("_close", F.lit(_END)), 0, F.lit(1), F.col("line"), F.col("_last"), held)))
            again = F.min("_island").over(Window.partitionBy("session_key", "_mid"))
            fatal = F.when(F.col("_new") & (again < F.col("_island")), F.format_string("assistant message %s resumed after its fold closed", F.col("_mid")))
    bad = fatal if options.permissive else F.coalesce(fatal, F.col("problem"))
    version = F.coalesce(F.col("version_so_far"), hint) if harness != "antigravity" else hint
    rows = rows.withColumn("_error", bad).withColumn("_bad_line", F.min(F.when(F.col("_error").isNotNull(), F.col("line"))).over(by))
    errors = rows.where(F.col("line") == F.col("_bad_line")).select("session_key", F.lit(harness).alias("harness"), version.alias("version"), "line", F.col("_error").alias("reason"), F.coalesce(version_newer(version, F.lit(LAST_VALIDATED[harness])), F.lit(False)).alias("newer"))
    good = rows.where(F.col("_bad_line").isNull())
    skips = good.where(F.col("skip").isNotNull()).select("session_key", "line", F.col("skip").alias("record_type"))
    events = good.select("session_key", F.explode(F.concat(extra, _own(options, major))).alias("p"))
    seq = Window.partitionBy("session_key").orderBy("p.major", "p.minor", "p.sub")
    events = events.select("session_key", (F.row_number().over(seq) - 1).cast("long").alias("seq"), *(F.col(f"p.e.{c}").alias(c) for c in ("kind", "ts_us", "id", "parent_id", "message_id")), "p.line", "p.end_line", "p.raw", *(F.col(f"p.e.{c}").alias(c) for c in PAYLOADS), F.col("p.e.own_name").alias("_own"))
    if harness != "antigravity":
        events = tool_names(events, F.coalesce("_own", F.lit(False)))
    events = cut_payloads(events, options.max_payload_bytes)
    return Parsed(events.select(*EVENTS.names), skips, errors, harness)


def parse_one(lines: DataFrame, harness: str, options: Options = Options()) -> Parsed:
    """The same for a single transcript: its error is raised.

    The decoded lines are kept, so that looking for errors and reading events decode once; ``extra["decoded"]``
    is theirs to unpersist.
    """
    rows = decoded(lines, harness).persist()
    found = parse(rows, harness, options)
    worst = found.errors.orderBy("line").first()
    if worst is not None:
        rows.unpersist()
        raise TranscriptError(harness, worst["version"], worst["line"], worst["reason"], worst["newer"])
    found.extra["decoded"] = rows
    return found
