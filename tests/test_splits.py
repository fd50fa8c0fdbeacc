"""Numbering by split, reading heads, listing by folder, gaps between spans, and views."""

import os
import random

import pyarrow.fs as pafs
import pytest
from fixtures import CLAUDE, CODEX, jsonl

from scribeflow.operators.validate import gaps, uncovered_lines
from scribeflow.plans.views import views_of_folder
from scribeflow.sources import discover, listing, splits
from scribeflow.sources.lines import read_lines
from scribeflow.sources.transcripts import parse


def shown(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("split", [1, 3, 7, 1 << 20])
def test_any_split_numbers_the_same(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {"a": "﻿one\r\n\n two \nthree", "b": "\n\n\n", "c": "", "d": "x" * 40 + "\n" + "é\n" * 5, "e": "last\n", "f": "".join(rng.choice("ab\n ") for _ in range(120)), "g": "no end", "h i%20é": "name"}
    for name, text in texts.items():
        (tmp_path / f"{name}.jsonl").write_bytes(text.encode())
    assert shown(splits.numbered_splits(spark, str(tmp_path), split=split)) == shown(read_lines(spark, str(tmp_path)).select("session_key", "line", "text"))


def test_long_lines_over_many_blocks(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.jsonl"
    path.write_text("short\n" + "y" * 3_000_000 + "\nend\n")
    for step in (1_000_000, 500_000):
        got = [x for at in range(0, path.stat().st_size, step) for x in splits.lines_of_split(str(path), at, min(at + step, path.stat().st_size), path.stat().st_size, path.read_bytes()[:at].count(b"\n"))]
        assert [(n, len(t)) for n, t in got] == [(1, 5), (2, 3_000_000), (3, 3)]


def test_parsing_needs_one_exchange(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(CODEX)
    lines = splits.numbered_splits(spark, str(tmp_path), split=100)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    found = parse(lines, "codex")
    assert shown(found.events) == shown(parse(read_lines(spark, str(tmp_path)), "codex").events)
    plan = parse(splits.numbered_splits(spark, str(tmp_path), split=100), "codex").events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") > plan.index("Exchange")


def test_heads_read_little(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("one\ntwo\n" + "z" * 100)
    (tmp_path / "b.jsonl").write_text("whole")
    files = [(str(path), path.stat().st_size), (str(tmp_path / "b.jsonl"), 5)]
    assert [(n, t) for _, n, t in shown(splits.heads(spark, files, 10))] == [(1, "one"), (2, "two"), (1, "whole")]
    reader = splits.SplitReader({"files": '[["/x", 1000000000]]', "head": "65536"})
    assert [p.pieces for p in reader.partitions()] == [[("/x", 0, 65536, 65536, 0, True)]]


def test_identities_whatever_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(discover, "HEAD_BYTES", 300)
    skip = {"type": "last-prompt", "sessionId": "q"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "late.jsonl").write_text(jsonl(*[skip] * 200) + CLAUDE)
    (tmp_path / "p" / "soon.jsonl").write_text(CLAUDE + jsonl(*[skip] * 200))
    (tmp_path / "p" / "none.jsonl").write_text(jsonl(*[skip] * 200))
    found = discover.scan(spark, str(tmp_path), "claude-code")
    assert sorted(os.path.basename(r.path) for r in found.refs.collect()) == ["late.jsonl", "soon.jsonl"]
    assert [(os.path.basename(r.path), r.reason) for r in found.errors.collect()] == [("none.jsonl", "no events in transcript")]


def test_copies_with_old_times_are_found(spark, tmp_path):
    (tmp_path / "p").mkdir()
    path = tmp_path / "p" / "count-1.jsonl"
    path.write_text(CLAUDE)  # starts on 2026-03-04
    os.utime(path, (1_600_000_000, 1_600_000_000))
    since = discover.parse_when("2026-03-01T00:00:00Z")
    assert discover.scan(spark, str(tmp_path), "claude-code", since_us=since).refs.count() == 1
    assert discover.scan(spark, str(tmp_path), "claude-code", since_us=since + 10**13).refs.count() == 0
    assert discover.located(spark, str(tmp_path), "claude-code", "count-1", since).refs.count() == 1
    assert discover.located(spark, str(tmp_path), "claude-code", "count-1", since + 10**13).refs.count() == 0


def test_all_skip_reasons(spark, tmp_path, monkeypatch):
    for rel in ("c/stray.txt", "c/p/notes.txt", "c/p/s/other.txt", "c/p/s/subagents/odd.txt", "c/p/bad/x.jsonl", "c/p/worse/subagents/agent-a.jsonl", "x/2026/03/04/notes.txt", "g/stray.txt", "g/conv/.system_generated/logs/transcript_full.jsonl", "g/conv/.hidden/side.txt", "g/lost/a.txt"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("")
    whole = listing.entries

    def some(fs, folder):
        if folder.endswith(("/p/bad", "/worse/subagents")):
            raise PermissionError(13, "Permission denied")
        return whole(fs, folder)

    monkeypatch.setattr(listing, "entries", some)  # what a task does, done here
    reasons = {}
    for root, harness in (("c", "claude-code"), ("x", "codex"), ("g", "antigravity")):
        reader = listing.ListingReader(str(tmp_path / root), harness == "codex", None, None)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(rows) == len({r[0] for r in rows})
        files = discover.classify(spark.createDataFrame(rows, listing.FILES), harness)
        reasons[root] = sorted((r.rel, r.reason) for r in files.where("reason is not null").collect())
    assert reasons["c"] == [
        ("p/bad", "unreadable session directory"),
        ("p/notes.txt", "not a session transcript"),
        ("p/s/other.txt", "session directory sidecar"),
        ("p/s/subagents/odd.txt", "not a subagent transcript"),
        ("p/worse/subagents", "unreadable subagents directory"),
        ("stray.txt", "not a project directory"),
    ]
    assert reasons["x"] == [("2026/03/04/notes.txt", "not a session transcript")]
    assert reasons["g"] == [("conv/.hidden/side.txt", "conversation sidecar"), ("lost/a.txt", "conversation directory without transcript"), ("stray.txt", "not a conversation directory")]


def test_days_outside_are_never_opened(tmp_path, monkeypatch):
    for rel in ("2026/03/01", "2026/03/04", "2026/03/09", "2026/13/99", "other/2026/03/01", "2026/03/x"):
        (tmp_path / rel).mkdir(parents=True)
        (tmp_path / rel / "rollout-a.jsonl").write_text("")
    opened = []
    whole = listing.entries
    monkeypatch.setattr(listing, "entries", lambda fs, folder: opened.append(os.path.relpath(folder, tmp_path)) or whole(fs, folder))
    day = discover.parse_when("2026-03-04T12:00:00Z")
    reader = listing.ListingReader(str(tmp_path), True, day, day)
    found = {r[1] for p in reader.partitions() for r in reader.read(p)}
    assert found == {f"{d}/rollout-a.jsonl" for d in ("2026/03/04", "2026/13/99", "other/2026/03/01", "2026/03/x")}
    assert not {"2026/03/01", "2026/03/09"} & set(opened)
    assert isinstance(splits.file_system("file:///tmp/x")[0], pafs.LocalFileSystem)


def test_gaps_between_spans(spark):
    long = 10_000_000
    events = spark.createDataFrame([("a", 1, long), ("a", 5, 7), ("a", long + 3, None), ("b", 2, 2), ("b", 1, 4), ("b", 9, 9)], "session_key string, line int, end_line int")
    skips = spark.createDataFrame([("b", 6), ("a", long + 5)], "session_key string, line int")
    lines = spark.createDataFrame([("a", n) for n in (1, 6, long, long + 1, long + 3, long + 4, long + 5)] + [("b", n) for n in range(1, 12)] + [("c", 1)], "session_key string, line int")
    left = uncovered_lines(lines, events, skips)
    assert shown(left) == [("a", long + 1), ("a", long + 4), ("b", 5), ("b", 7), ("b", 8), ("b", 10), ("b", 11), ("c", 1)]
    assert shown(uncovered_lines(lines, events, skips, spark.createDataFrame([("c", 1), ("b", 5)], "session_key string, line int")))[2:4] == [("b", 7), ("b", 8)]
    assert "sequence" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert shown(gaps(events, skips)) == [("a", long + 1, long + 2), ("a", long + 4, long + 4), ("b", 5, 5), ("b", 7, 8)]


def test_views(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(CLAUDE)
    views_of_folder(spark, "claude-code", str(tmp_path), prefix="t_")
    row = spark.sql("SELECT s.tool_calls, s.final_answer, (SELECT count(*) FROM t_skips) AS skipped, (SELECT count(*) FROM t_interactions i WHERE NOT i.has_call) AS orphans, (SELECT count(*) FROM t_events) AS n FROM t_stats s").first()
    assert (row.tool_calls, row.final_answer, row.skipped, row.orphans) == (3, "Three files.", 3, 1) and row.n > 10
