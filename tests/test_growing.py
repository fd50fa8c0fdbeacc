"""Streams over growing files: the standing events equal the batch parser's after each append."""

import json

import pytest
from fixtures import ANTIGRAVITY, CLAUDE, CODEX, jsonl

from scribeflow.sources.files import Piece, last_line_end, read_piece, walk
from scribeflow.sources.growing import GrowingReader
from scribeflow.sources.lines import lines_of
from scribeflow.sources.transcripts import Options, parse
from scribeflow.streaming.incremental import LOG, follow_log, new_bytes, standing


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def same(spark, log, texts, harness, options, kinds=("events", "skips", "errors")):
    got, want = standing(spark, log, harness, options), parse(lines_of(spark, texts), harness, options)
    for kind in kinds:
        a, b = (sorted(map(str, getattr(x, kind).collect())) for x in (got, want))
        assert a == b, kind


def run(spark, root, harness, base, options, **more):
    query = follow_log(new_bytes(spark, str(root), **more), harness, f"{base}/log", f"{base}/checkpoint", options)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("harness,text", [("claude-code", CLAUDE), ("codex", CODEX), ("antigravity", ANTIGRAVITY)])
def test_growing_files(spark, tmp_path, harness, text):
    """Two files grow in uneven parts, lines are cut in the middle, and each trigger is a restart."""
    root, base = tmp_path / "in", tmp_path / "out"
    (root / "deep").mkdir(parents=True)
    one, two = root / "a.jsonl", root / "deep" / "b.jsonl"
    options = Options(permissive=True, keep_raw=True)
    data = {one: ("﻿" + text).encode(), two: text.replace("\n", "\r\n\n").encode()}
    done = {one: 0, two: 0}
    for i, (share, cut) in enumerate(((0.3, 7), (0.6, 0), (1.0, 0))):
        for path, whole in data.items():
            to = int(len(whole) * share) - cut if i % 2 == 0 or path == one else done[path]
            to = len(whole) if share == 1.0 else max(to, done[path])
            with open(path, "ab") as f:
                f.write(whole[done[path] : to])
            done[path] = to
        run(spark, root, harness, base, options, pieceBytes=50)
        standing_now = {str(p): d[: done[p]][: d[: done[p]].rfind(b"\n") + 1].decode() for p, d in data.items()}
        same(spark, f"{base}/log", standing_now, harness, options, ("events", "skips") if share == 1.0 else ("events",))
    before = spark.read.schema(LOG).parquet(f"{base}/log").count()
    run(spark, root, harness, base, options)  # nothing new
    assert spark.read.schema(LOG).parquet(f"{base}/log").count() == before
    final = spark.read.schema(LOG).parquet(f"{base}/log").where("what = 'event'")
    if harness != "antigravity":  # nothing is said twice
        assert final.count() == final.select("session_key", "seq").distinct().count()


def test_steps_out_of_order(spark, tmp_path):
    step = lambda n, t, **k: {"step_index": n, "source": "MODEL", "type": t, "created_at": "2026-01-01T00:00:00Z"} | k
    rows = [step(2, "PLANNER_RESPONSE", content="hm", tool_calls=[{"name": "a"}, {"name": "b"}]), step(5, "VIEW_FILE", content="late"), step(3, "ASK_QUESTION", content="first"), {"type": "no step"}, step(1, "USER_INPUT", content="q"), step(6, "LIST_DIRECTORY", content="z")]
    root = tmp_path / "in"
    root.mkdir()
    text = ""
    for some in (rows[:2], rows[2:4], rows[4:]):
        text += jsonl(*some)
        (root / "x.jsonl").write_text(text)
        run(spark, root, "antigravity", tmp_path / "out", Options(permissive=True))
        same(spark, f"{tmp_path}/out/log", {str(root / "x.jsonl"): text}, "antigravity", Options(permissive=True), ("events",))


def test_errors_end_a_session(spark, tmp_path):
    say = lambda mid: {"type": "assistant", "version": "99.0", "message": {"id": mid, "content": [{"type": "text", "text": "t"}]}}
    root = tmp_path / "in"
    root.mkdir()
    parts = [jsonl(say("m"), say("m")), jsonl(say("n"), say("m")), jsonl(say("o"))]
    for i in (0, 2):
        (root / "x.jsonl").write_text("".join(parts[: i + 1]))
        (root / "y.jsonl").write_text(jsonl(*[{"type": "who"}] * i))
        run(spark, root, "claude-code", tmp_path / "out", Options())
        same(spark, f"{tmp_path}/out/log", {str(root / "x.jsonl"): "".join(parts[: i + 1]), str(root / "y.jsonl"): jsonl(*[{"type": "who"}] * i)}, "claude-code", Options(), ("events", "errors"))


def test_payloads_are_cut_when_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.jsonl").write_text(CLAUDE)
    options = Options(permissive=True, max_payload_bytes=6)
    run(spark, tmp_path / "in", "claude-code", tmp_path / "out", options)
    same(spark, f"{tmp_path}/out/log", {str(tmp_path / "in" / "c.jsonl"): CLAUDE}, "claude-code", options, ("events",))


def test_only_new_bytes_are_read(tmp_path, monkeypatch):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"one\n" * 1000 + b"tail")
    reader = GrowingReader(str(tmp_path), ".jsonl", 1000, 1 << 20)
    first = reader.latestOffset()
    assert first == {"files": {str(path): 4000}}
    parts = reader.partitions(reader.initialOffset(), first)
    assert b"".join(d for p in parts for _, _, d in reader.read(p)) == b"one\n" * 1000
    with open(path, "ab") as f:
        f.write(b"!\ntwo\nthr")
    read = []
    monkeypatch.setattr("scribeflow.sources.files.read_piece", lambda p: read.append(p) or read_piece(p))
    again = GrowingReader(str(tmp_path), ".jsonl", 1000, 1 << 20)  # after a restart
    again.partitions(first, first)
    second = again.latestOffset()
    assert second == {"files": {str(path): 4010}} and all(p.start >= 4000 for p in read)
    assert [x for p in again.partitions(first, second) for x in again.read(p)] == [(str(path), 4000, b"tail!\ntwo\n")]
    path.write_bytes(b"short\n")
    assert again.latestOffset() == second
    assert json.loads(json.dumps(second)) == second


def test_triggers_take_large_files_in_parts(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"x" * 99 + b"\n" + b"y" * 500 + b"\n" + b"z\n" * 100)
    reader = GrowingReader(str(tmp_path), ".jsonl", 1000, 120)
    seen = [reader.latestOffset()["files"].get(str(path), 0) for _ in range(5)]
    assert seen[0] == 100 and seen[1] == 801 or seen[1] == 601 and seen[-1] == 801


def test_files_by_place(tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"ab\ncd\nef")
    assert last_line_end(str(path), 0, 8) == 6 and last_line_end(str(path), 6, 8) == 6 and last_line_end(f"file:{path}", 0, 8, block=1) == 6
    assert read_piece(Piece(f"file://{path}", 3, 5)) == b"cd"
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.txt").write_text("x")
    assert sorted(walk(str(tmp_path), ".txt")) == [(str(tmp_path / ".hidden" / "b.txt"), 1), (str(path), 8)]
    assert list(walk(str(tmp_path / "none"))) == []
