import json
import os
import random
import time

import pytest
from conftest import SF
from fixtures import ANTIGRAVITY, CLAUDE, CODEX, jsonl
from pyspark.sql import functions as F

from scribeflow import cli
from scribeflow.functions.columns import overlaps_window, parse_time, safe_session_id, version_newer
from scribeflow.functions.strict_json import Obj, elements, micros, slices
from scribeflow.operators import drift, sequence, sinks
from scribeflow.plans.schema import EVENTS
from scribeflow.sources import discover
from scribeflow.sources.detect import detect
from scribeflow.sources.lines import lines_of, read_lines
from scribeflow.sources.transcripts import Options, parse
from scribeflow.streaming.sessions import activity, catch_up, current, follow


def test_every_leaf_names_its_vocabulary():
    def walk(t):
        for f in t.fields:
            assert f.metadata.get("schema") in ("acp", "otel", "ext"), f.name
            inner = f.dataType.elementType if hasattr(f.dataType, "elementType") else f.dataType
            if hasattr(inner, "fields"):
                walk(inner)

    walk(EVENTS)


def test_strict_json():
    assert slices('{"a": 1.0, "b":{"x" :2} ,"a":[1, 2]}') == {"a": "[1, 2]", "b": '{"x" :2}'}
    assert elements('[1, "a" , {"b":2}]') == ["1", '"a"', '{"b":2}']
    for bad in ('{"a":1} x', "[1", '{"a":NaN}', "{'a':1}"):
        with pytest.raises(ValueError):
            Obj(bad)
    assert micros("2026-01-01T00:00:00.123456789Z") - micros("2026-01-01T00:00:00+00:00") == 123456
    assert micros("2026-01-01") is None and micros("") is None


def test_versions_times_and_windows(spark):
    cases = [("2.1.10", "2.1.9", True), ("2.1.9", "2.1.10", False), ("2", "2.0.0", False), ("2.0.1", "2", True), ("0.144.0-alpha", "0.143", True), ("x", "1", False), ("1.x", "1.0", False), ("", "1", False), ("1", "", False), ("2.x", "1.0", True)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert rows.where(version_newer(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    times = spark.createDataFrame([("2026-01-01T00:00:01Z",), ("2026-01-01",), ("x",), ("",)], "t string").select(parse_time(F.col("t"))).collect()
    assert [t[0] for t in times] == [1767225601000000, None, None, None]
    ids = spark.createDataFrame([("a-1", True), ("", False), ("a/b", False), ("..", False), ("a*", False)], "i string, want boolean")
    assert ids.where(safe_session_id(F.col("i")) != F.col("want")).count() == 0
    spans = spark.createDataFrame([(5, 9, True), (None, 9, True), (11, 12, False), (1, 2, False), (10, 10, True), (20, 8, False)], "s long, m long, want boolean")
    assert spans.where(overlaps_window(F.col("s"), F.col("m"), 3, 10) != F.col("want")).count() == 0


def test_detection(spark):
    found = {r["session_key"]: (r["harness"], r["confidence"]) for r in detect(lines_of(spark, {"a": CLAUDE, "b": CODEX, "c": ANTIGRAVITY, "d": "hello\n", "e": '{"type":"summary"}\n', "f": '{"parentUuid":"x","sessionId":"y'})).collect()}
    assert found == {"a": ("claude-code", "possible"), "b": ("codex", "certain"), "c": ("antigravity", "certain"), "d": (None, "no-match"), "e": ("claude-code", "possible"), "f": ("claude-code", "possible")}


def _pool(rows):
    """Anchors with their pooled tokens, by going through the rows once."""
    fold, pending, out = None, None, {}
    for i, (opens, closes, tokens) in enumerate(rows):
        if closes and fold is not None:
            out[fold], fold, pending = (i, pending), None, None
        if opens:
            fold = i
        if tokens is not None:
            pending = (pending or 0) + tokens
    if fold is not None:
        out[fold] = (None, pending)
    return out


def test_pool_equals_a_sequential_pass(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for s in range(60):
        part = []
        for _ in range(rnd.randint(1, 14)):
            kind = rnd.choice("octx")
            part.append((kind == "o", kind in "oc", rnd.randint(1, 9) if kind == "t" else None))
        want |= {(str(s), k): v for k, v in _pool(part).items()}
        rows += [(str(s), i, *p) for i, p in enumerate(part)]
    df = spark.createDataFrame(rows, "session_key string, seq long, o boolean, c boolean, tokens long")
    got = sequence.closing_lines(df, F.col("o"), F.col("c"), "seq")
    pools = got.where("owner_close is not null").groupBy("session_key", "owner_close").agg(F.sum("tokens").alias("tokens"))
    anchors = got.where("o").select("session_key", "seq", "close_line", F.coalesce("close_line", F.lit(2**63 - 1)).alias("owner_close")).join(pools, ["session_key", "owner_close"], "left")
    assert {(r.session_key, r.seq): (r.close_line, r.tokens) for r in anchors.collect()} == want


def test_lines_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {i}\n\n" for i in range(3000))
    (tmp_path / "a.jsonl").write_text("﻿" + text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line, r.text) for r in rows] == [(2 * i + 1, f"line {i}") for i in range(3000)]


def test_drift(spark):
    base = drift.vocabulary(lines_of(spark, {"a": CODEX}), "codex")
    again = sinks.read_baseline(sinks.baseline_json(base, "1").first()["value"], spark)
    assert again.exceptAll(base).count() == 0 and base.exceptAll(again).count() == 0
    seen = drift.vocabulary(lines_of(spark, {"a": jsonl({"type": "event_msg", "payload": {"type": "novel", "z": 1}}, {"type": "brand_new"}, {"x": 1})}), "codex")
    found = {(r.finding, r.record_type, r.value) for r in drift.drift(base, seen).collect()}
    assert {("new_record_type", "brand_new", ""), ("new_record_type", "(untyped)", ""), ("new_value", "event_msg", "novel"), ("new_key", "event_msg", "payload.z"), ("unexercised", "response_item", "")} <= found
    assert drift.worst(["clean", "exec-error", "drift"]) == "drift" and drift.worst(["inconclusive", "exec-error"]) == "exec-error"
    assert drift.EXIT_CODES == {"clean": 0, "drift": 1, "inconclusive": 2, "exec-error": 3}
    assert drift.report_lines(drift.drift(base, seen)).first()["line"].startswith("  drift: the baseline lacks record type")


def _tree(root):
    for path, text in {"c/-srv-one/count-1.jsonl": CLAUDE, "c/-srv-one/count-1/subagents/agent-a1.jsonl": CLAUDE, "c/-srv-two/lost/subagents/agent-b.jsonl": CLAUDE, "c/-srv-one/notes.txt": "x", "c/stray.txt": "x", "x/2026/03/04/rollout-1-sum-9.jsonl": CODEX, "x/2026/03/04/other.txt": "x", "g/conv/.system_generated/logs/transcript_full.jsonl": ANTIGRAVITY, "g/conv/side.txt": "x", "g/none/a.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_discovery(spark, tmp_path):
    _tree(tmp_path)
    c = discover.scan(spark, str(tmp_path / "c"), "claude-code")
    refs = sorted((r.path.rsplit("/", 1)[-1], r.session_id, len(r.subagent_paths)) for r in c.refs.collect())
    assert refs == [("agent-b.jsonl", "count-1", 0), ("count-1.jsonl", "count-1", 1)]
    assert sorted(r.reason for r in c.skips.collect()) == ["not a project directory", "not a session transcript"]
    x = discover.scan(spark, str(tmp_path / "x"), "codex")
    assert [r.session_id for r in x.refs.collect()] == ["sum-9"] and x.errors.count() == 0
    assert discover.scan(spark, str(tmp_path / "x"), "codex", until_us=discover.parse_when("2025-06-01")).refs.count() == 0
    g = discover.scan(spark, str(tmp_path / "g"), "antigravity")
    assert [r.session_id for r in g.refs.collect()] == ["conv"]
    assert sorted(r.reason for r in g.skips.collect()) == ["conversation directory without transcript", "conversation sidecar"]
    assert discover.locate(spark, str(tmp_path / "c"), "claude-code", "count-1").count() == 1
    with pytest.raises(FileNotFoundError):
        discover.locate(spark, str(tmp_path / "x"), "codex", "zz")
    assert discover.scan(spark, str(tmp_path / "none"), "codex").skips.first()["reason"] == "root does not exist"


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "t.jsonl"
    path.write_text(CODEX)
    assert cli.main(["detect", str(path)]) == 0 and "codex (certain)" in capsys.readouterr().out
    assert cli.main(["convert", str(path), "--format", "jsonl", "--promote", "codex:patch-apply"]) == 0
    out = capsys.readouterr()
    assert [json.loads(x)["kind"] for x in out.out.splitlines()][:2] == ["session_meta", "system"] and "19 events, 2 skipped records" in out.err
    assert cli.main(["stats", str(path)]) == 0 and json.loads(capsys.readouterr().out)["tool_calls"] == 2
    assert cli.main(["convert", str(path)]) == 0 and len(json.loads(capsys.readouterr().out)["events"]) == 18
    assert cli.main(["convert", str(path), "--format", "acp"]) == 0 and '"sessionUpdate":"tool_call"' in capsys.readouterr().out
    assert cli.main(["convert", str(path), "--promote", "nope"]) == 1 and "unknown promotion" in capsys.readouterr().err


def test_drift_command(spark, tmp_path, capsys):
    good, odd, none = (tmp_path / f"{n}.jsonl" for n in ("good", "odd", "none"))
    good.write_text(jsonl(*[json.loads(x) for x in CODEX.splitlines() if '"text":"hm"' not in x and '"chunk"' not in x and "image_url" not in x]))
    odd.write_text(jsonl({"timestamp": "2026-03-04T11:00:00Z", "type": "session_meta", "payload": {"id": "i", "cli_version": "9.9.9"}}, {"timestamp": "2026-03-04T11:00:01Z", "type": "invented", "payload": {}}))
    none.write_text("nothing known\n")
    base = tmp_path / "base.json"
    assert cli.main(["drift", "baseline", str(good), "--harness", "codex", "-o", str(base)]) == 0
    assert cli.main(["drift", "scan", str(good), "--baseline", str(base)]) == 0 and "clean" in capsys.readouterr().out
    assert cli.main(["drift", "scan", str(none)]) == 3 and "no known format" in capsys.readouterr().out
    assert cli.main(["drift", "scan", str(good), str(odd), str(none), "--baseline", str(base)]) == 1
    out = capsys.readouterr().out
    assert "lacks record type invented" in out and "version 9.9.9 was not validated" in out and "no known format" in out and out.count("  clean") == 1
    assert cli.main(["drift", "baseline", str(none), "--harness", "codex"]) == 3
    assert cli.main(["drift", "scan", str(tmp_path / "gone.jsonl")]) == 3


def test_one_exchange_of_identities_and_heads(spark):
    lines = lines_of(spark, {"a": jsonl(*[{"type": "mode"}] * 40) + CLAUDE, "b": CLAUDE})
    found = {r["session_key"]: (r["meta"]["session_id"], r["problem"]) for r in discover.identities(lines, "claude-code").collect()}
    assert found == {"a": ("count-1", None), "b": ("count-1", None)}


def test_following_files_that_grow(spark, tmp_path):
    root, sink = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "a.jsonl").write_text(CODEX)
    assert catch_up(spark, str(root), "codex", sink).count() == 1 and current(spark, sink).count() == 18
    assert catch_up(spark, str(root), "codex", sink).count() == 0 and current(spark, sink).count() == 18
    with open(root / "a.jsonl", "a") as f:
        f.write(jsonl({"timestamp": "2026-03-04T11:00:40Z", "type": "event_msg", "payload": {"type": "task_complete"}}))
    (root / "b.jsonl").write_text(CODEX)
    assert catch_up(spark, str(root), "codex", sink).count() == 2
    events = current(spark, sink)
    assert events.count() == 19 + 18 and activity(events).agg(F.sum("events")).first()[0] == 37


def test_following_by_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(CODEX)
    sink, seen = str(tmp_path / "out"), []
    query = follow(spark, str(tmp_path / "in"), "codex", sink, str(tmp_path / "ck"), after=lambda fresh, n: seen.append(fresh.count()), every="1 second")
    try:
        for _ in range(120):
            if seen:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert seen[0] == 1 and current(spark, sink).count() == 18


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"} <= set(entry.oracle_sql())
    assert os.path.exists(SF)
    assert parse(lines_of(spark, {"a": CODEX}), "codex").errors.count() == 0


def test_adapters_and_transforms(spark):
    from scribeflow.operators.promote import promote_patch_apply, promote_web_search
    from scribeflow.sources.registry import ADAPTERS, adapter_for, parse_with

    assert list(ADAPTERS) == sorted(ADAPTERS)
    assert parse_with(lines_of(spark, {"a": CODEX}), "codex", Options(), promote_web_search, promote_patch_apply).events.count() == 19
    with pytest.raises(ValueError, match="unknown harness"):
        adapter_for("none")


def test_files_are_accounted_for(spark, tmp_path):
    from scribeflow.operators.validate import uncovered_files

    _tree(tmp_path)
    for name, harness in (("c", "claude-code"), ("x", "codex")):
        found = discover.scan(spark, str(tmp_path / name), harness)
        assert uncovered_files(discover.list_files(spark, str(tmp_path / name)), found.refs, found.skips, found.errors).count() == 0
