"""Parsing transcripts as they grow: only new lines are read and decoded, what is open waits in the state store.

A stream of new bytes (``growing_files``) is grouped by session. The state of a session is what the batch
parser's windows would look back for: the line and event counts, the open message and its usage pool, the names of
calls by id, the messages that are closed, the calls that wait for results, the model and version in force.
Each trigger appends to a log: events that can't change any more, skipped records, the error that ends a
transcript, and the message that is still open, marked as such. ``standing`` reads the log as the event table
that the batch parser would give for the files as they are, up to their last line feed.

Steps that arrive out of order (the format of numbered steps only) can change what was said before: the session's
lines, kept in its state, are then gone through again and replace what stands, under a new generation.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.columns import LAST_VALIDATED, version_newer
from ..plans.schema import EVENTS
from ..sources import decode
from ..sources.growing import GrowingFiles
from ..sources.lines import BOM, TRIM
from ..sources.transcripts import Options, Parsed, cut_payloads

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOG = T.StructType.fromJson(
    {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("session_key", "string"), ("generation", "long"), ("tick", "long"), ("what", "string"), ("seq", "long"), ("line", "integer"), ("said", "string"), ("body", "string"))]}
)
_BODY = T.StructType([*(f for f in EVENTS.fields if f.name not in ("session_key", "seq")), T.StructField("own_name", T.BooleanType())])
_ROW = Row(*LOG.names)
_END = 2**62


class Follower:
    """One session's reader: ``read`` takes its next lines in order and leaves (what, seq, line, said, body) in ``out``.

    ``state`` is a dict of plain values; ``names`` and ``closed`` are looked up and set by key.
    """

    def __init__(self, harness: str, options: Options, state: dict, names, closed) -> None:
        self.harness, self.options, self.s, self.names, self.closed = harness, options, state, names, closed
        self.out: list[tuple] = []

    def _raw(self, *texts: str) -> list[str] | None:
        return list(texts) if self.options.keep_raw else None

    def _put(self, event: dict, line: int, end: int, raw: list[str] | None, what: str = "event") -> None:
        call, result = event.get("tool_call"), event.get("tool_result")
        if self.harness != "antigravity":
            if call is not None:
                self.names[call["tool_call_id"]] = call.get("name") or ""
            elif result is not None and not event.get("own_name"):
                event = event | {"tool_result": result | {"tool_name": self.names.get(result["tool_call_id"]) or None}}
        seq = self.s["seq"]
        if what == "event":
            self.s["seq"] = seq + 1
        self.out.append((what, seq, line, None, event | {"line": line, "end_line": end, "raw": raw}))

    def _made(self, kind: str, payload: str, value: dict, ts: int | None, ident: str | None = None, parent: str | None = None, message: str | None = None) -> dict:
        return {"kind": kind, "ts_us": ts, "id": ident, "parent_id": parent, "message_id": message, payload: value}

    def _anchor(self) -> tuple[dict, int, int, list[str] | None]:
        """The open message as an event."""
        a = self.s["open"]
        value = {"model": a["model"], "content": a["content"], "stop_reason": a.get("stop"), "usage": a.get("usage")}
        if value["usage"] and value["usage"]["extra"]:
            value["usage"] = value["usage"] | {"extra": dict(value["usage"]["extra"])}  # pairs become a map
        if self.harness == "codex":
            pool = self.s.get("pool")
            value |= {"stop_reason": None, "usage": pool and pool | {"extra": None}}
        event = self._made("assistant_message", "assistant_message", value, a["ts"], a.get("id"), a.get("parent"), a.get("mid"))
        return event, a["line"], a["last"], a.get("raw")

    def _close(self) -> None:
        if self.s.get("open"):
            self._put(*self._anchor())
            self.s["open"] = None
            self.s["pool"] = None

    def _fail(self, line: int, reason: str, version: str | None) -> None:
        self.s["dead"] = True
        self.out.append(("error", self.s["seq"], line, reason, {"version": version}))

    def _message(self, line: int, text: str, rec: dict) -> str | None:
        """Opens or extends the message of an assistant record; what is fatal about it."""
        fold, a = rec["fold"], self.s.get("open")
        mid = fold["message_id"]
        if a and a["mid"] == mid:
            a["content"] += fold["content"]
            a["stop"] = fold["stop_reason"] or a["stop"]
            a["usage"] = fold["usage"] or a["usage"]
            a["last"] = line
            if self.options.keep_raw:
                a["raw"].append(text)
            return None
        self._close()
        if self.closed.get(mid):
            return f"assistant message {mid} resumed after its fold closed"
        self.closed[mid] = "1"
        self.s["open"] = {"mid": mid, "model": fold["model"], "content": list(fold["content"]), "stop": fold["stop_reason"], "usage": fold["usage"], "ts": rec["ts_us"], "id": rec.get("uuid") or None, "parent": rec.get("parent") or None, "line": line, "last": line, "raw": self._raw(text)}
        return None

    def _lost(self, line: int, text: str, rec: dict) -> None:
        value = {"record_type": rec.get("record_type") or None, "reason": rec["problem"], "raw": text}
        self._put(self._made("unknown", "unknown", value, None), line, line, None)

    def read(self, lines: list[tuple[int, str]]) -> None:
        one = {"claude-code": lambda n, t: decode.claude_code(t), "codex": lambda n, t: decode.codex(t, n), "antigravity": lambda n, t: decode.antigravity(t)}[self.harness]
        for line, text in lines:
            if self.s.get("dead"):
                return
            rec = one(line, text)
            (self._step if self.harness == "antigravity" else self._record)(line, text, rec)

    def _record(self, line: int, text: str, rec: dict) -> None:
        s, hint = self.s, self.options.version_hint or None
        s["version"] = rec.get("version") or s.get("version")
        version = s["version"] or hint
        items = rec["items"]
        if rec.get("meta") is not None and not s.get("met"):
            s["met"] = True
            meta = rec["meta"] | {"harness_version": rec["meta"].get("harness_version") or hint}
            self._put(self._made("session_meta", "meta", meta, rec["ts_us"]), line, line, self._raw(text))
            if self.harness == "codex" and not rec["sparse"]:
                items = []
        fatal = None
        if self.harness == "codex":
            s["model"] = rec.get("model") or s.get("model")
            if rec.get("closes"):
                self._close()
            if rec.get("opens"):
                s["open"] = {"model": s["model"], "content": rec["fold"]["content"], "ts": rec["ts_us"], "line": line, "last": line, "raw": self._raw(text)}
            if rec.get("pool"):
                s["pool"] = {k: (s.get("pool") or {}).get(k, 0) + v for k, v in rec["pool"].items()}
        elif rec.get("fold") is not None:
            fatal = self._message(line, text, rec)
        problem = fatal or (None if self.options.permissive else rec.get("problem"))
        if problem:
            self._fail(line, problem, version)
            return
        if rec.get("skip") is not None:
            self.out.append(("skip", s["seq"], line, rec["skip"], None))
        for e in items:
            self._put(e, line, line, self._raw(text))
        if rec.get("problem"):
            self._lost(line, text, rec)

    def _step(self, line: int, text: str, rec: dict) -> None:
        s, hint = self.s, self.options.version_hint or None
        step = rec.get("step")
        if not s.get("met"):
            s["met"] = True
            self._put(self._made("session_meta", "meta", {"harness": "antigravity", "harness_version": hint}, rec["ts_us"]), line, line, self._raw(text))
        s["model"] = rec.get("model") or s.get("model")
        if rec.get("names") is not None:
            s["plan"] = {"step": step, "names": rec["names"], "taken": 0}
        plan = s.get("plan")
        index = None
        takes = rec.get("takes")
        if takes and plan:
            index = plan["taken"] if plan["taken"] < len(plan["names"]) else None
            plan["taken"] += 1
        if rec.get("problem") and not self.options.permissive:
            self._fail(line, rec["problem"], hint)
            return
        for e in rec["items"]:
            if takes == "either" and e["kind"] != ("tool_result" if index is not None else "system"):
                continue
            if e["kind"] == "tool_result":
                ident = f"step-{plan['step']}:call-{index}" if index is not None else f"step-{step}:orphan"
                e = e | {"tool_result": e["tool_result"] | {"tool_call_id": ident, "tool_name": plan["names"][index] or None if index is not None else None}}
            elif e["kind"] == "assistant_message":
                e = e | {"assistant_message": e["assistant_message"] | {"model": s["model"]}}
            self._put(e, line, line, self._raw(text))
        if rec.get("problem"):
            self._lost(line, text, rec)


class _Held(dict):
    """A map in the state store, read through and written back once."""

    def __init__(self, store) -> None:
        super().__init__()
        self.store, self.fresh = store, {}

    def get(self, key, default=None):
        if key not in self:
            super().__setitem__(key, self.store.getValue((key,))[0] if self.store.containsKey((key,)) else None)
        return self[key] if self[key] is not None else default

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self.fresh[key] = value

    def save(self) -> None:
        for key, value in self.fresh.items():
            self.store.updateValue((key,), (value,))


def _new() -> dict:
    return {"lines": 0, "seq": 0, "tick": 0, "generation": 0, "after": [-1, 0]}


class _Processor(StatefulProcessor):
    def __init__(self, harness: str, options: Options) -> None:
        self.harness, self.options = harness, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")
        self.names = handle.getMapState("names", "key string", "value string")
        self.closed = handle.getMapState("closed", "key string", "value string")
        self.kept = handle.getListState("kept", "line int, text string") if self.harness == "antigravity" else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        s = json.loads(held[0]) if held else _new()
        data = b"".join(r.data for r in sorted(rows, key=lambda r: r.at))
        texts = data.decode("utf-8", "replace").removesuffix("\n").split("\n") if data else []
        first = s["lines"] + 1
        lines = [(n, t.removeprefix(BOM).strip(TRIM) if n == 1 else t.strip(TRIM)) for n, t in enumerate(texts, first)]
        lines = [(n, t) for n, t in lines if t]
        s["lines"] += len(texts)
        s["tick"] += 1
        if self.harness == "antigravity":
            follower = self._steps(s, lines)
        else:
            names, closed = _Held(self.names), _Held(self.closed)
            follower = Follower(self.harness, self.options, s, names, closed)
            follower.read(lines)
            names.save()
            closed.save()
        out = follower.out
        s = follower.s
        if s.get("open") and not s.get("dead"):
            at = len(out)
            follower._put(*follower._anchor(), what="open")
            assert len(out) == at + 1
        self.state.update((json.dumps(s),))
        for what, seq, line, said, body in out:
            yield _ROW(key[0], s["generation"], s["tick"], what, seq, line, said, json.dumps(body, ensure_ascii=False, default=dict) if body is not None else None)

    def _steps(self, s: dict, lines: list[tuple[int, str]]) -> Follower:
        """Lines in step order; from the start again if one belongs before what has been said."""

        def place(line: int, text: str) -> list[int]:
            step = decode.antigravity(text).get("step")
            return [step if step is not None else _END, line]

        placed = sorted((place(*x), x) for x in lines)
        for line, text in lines:
            self.kept.appendValue((line, text))
        if placed and placed[0][0] < s["after"]:
            every = [tuple(x) for x in self.kept.get()]
            placed = sorted((place(*x), x) for x in every)
            s = _new() | {"lines": s["lines"], "tick": s["tick"], "generation": s["generation"] + 1}
        if placed:
            s["after"] = placed[-1][0]
        follower = Follower(self.harness, self.options, s, {}, {})
        follower.read([x for _, x in placed])
        return follower


def new_bytes(spark: SparkSession, root: str, suffix: str = ".jsonl", **options) -> DataFrame:
    """A stream of (session_key, at, data) of the files below a folder; see ``growing_files``."""
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("suffix", suffix)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(root)


def follow_log(data: DataFrame, harness: str, log: str, checkpoint: str, options: Options = Options(permissive=True), every: str | None = None) -> StreamingQuery:
    """A query that parses new bytes and appends to the log, every so often or, without ``every``, once."""
    spark = data.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows = data.groupBy("session_key").transformWithState(_Processor(harness, options), LOG, "append", "none")
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", log).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def standing(spark: SparkSession, log: str, harness: str, options: Options = Options(permissive=True)) -> Parsed:
    """Events, skips and errors as the batch parser gives them, from the log; one exchange by session."""
    by = Window.partitionBy("session_key")
    rows = spark.read.schema(LOG).parquet(log).withColumn("_g", F.max("generation").over(by)).where("generation = _g")
    rows = rows.withColumn("_t", F.max("tick").over(by)).withColumn("_bad", F.max(F.when(F.col("what") == "error", 1).otherwise(0)).over(by))
    good = rows.where("_bad = 0")
    body = F.from_json("body", _BODY)
    events = good.where("what = 'event' or what = 'open' and tick = _t").select("session_key", "seq", body.alias("e")).select("session_key", "seq", "e.*").withColumnRenamed("own_name", "_own")
    events = cut_payloads(events, options.max_payload_bytes).select(*EVENTS.names)
    skips = good.where("what = 'skip'").select("session_key", "line", F.col("said").alias("record_type"))
    version = F.get_json_object("body", "$.version")
    errors = rows.where("what = 'error'").select("session_key", F.lit(harness).alias("harness"), version.alias("version"), "line", F.col("said").alias("reason"), F.coalesce(version_newer(version, F.lit(LAST_VALIDATED[harness])), F.lit(False)).alias("newer"))
    return Parsed(events, skips, errors, harness)
