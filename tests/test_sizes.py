"""Work that grows with the input is dealt to more tasks, not to larger ones."""

import json
import pickle

import pytest
from pyspark.sql import functions as F

from scribeflow.plans import native, session_files
from scribeflow.plans.stream_queries import by_name, transcript_files
from scribeflow.sources import splits
from scribeflow.sources.growing import GrowingReader
from scribeflow.sources.lines import read_lines
from scribeflow.sources.splits import SplitReader
from scribeflow.sources.transcripts import Options, parse

SF = "/root/testdata/sf0.001"


def test_sessions_go_to_as_many_tasks_as_asked(spark):
    lines = spark.range(400).select((F.col("id") % 90).cast("string").alias("session_key"), (F.floor(F.col("id") / 90) + 1).cast("int").alias("line"), F.lit('{"type":"novel"}').alias("text"))
    for given, n in ((0, 4), (23, 23)):
        events = parse(lines, "codex", Options(permissive=True, tasks=given)).events
        assert events.count() == 400
        assert events.rdd.getNumPartitions() == n


@pytest.mark.parametrize("harness", ["claude-code", "codex", "antigravity"])
def test_tables_of_events_go_to_tasks_by_their_rows(spark, monkeypatch, harness):
    few = native.parsed(spark, SF, harness).events
    monkeypatch.setattr(native, "TASK_EVENTS", 50)
    many = native.parsed(spark, SF, harness).events
    assert few.rdd.getNumPartitions() == 4
    assert many.rdd.getNumPartitions() == 1000 // 50 + 1
    assert many.count() == few.count()


def test_small_splits_share_tasks_which_get_no_list_of_files():
    files = [[f"/t/session_key={i}/part-0.txt", 20_000] for i in range(9000)]
    reader = SplitReader({"files": json.dumps(files), "splitbytes": "16384", "feeds": json.dumps({p: [3, 1] for p, _ in files})})
    parts = reader.partitions()
    pieces = [p for part in parts for p in part.pieces]
    assert len(pieces) == 18_000 and {(p[1], p[2], p[4]) for p in pieces} == {(0, 16_384, 0), (16_384, 20_000, 3)}
    assert len(parts) <= 9000 * 20_000 // (8 << 20) + 2
    assert len(pickle.dumps(reader)) < 2000


def test_files_below_folders_are_not_listed_in_the_driver(spark, tmp_path, monkeypatch):
    """Names and line feeds of files stay with tasks, of which the driver knows the numbers."""
    for i in range(150):
        (tmp_path / f"a{i % 7}" / f"b{i}").mkdir(parents=True)
        (tmp_path / f"a{i % 7}" / f"b{i}" / "c.txt").write_text("one\n\ntwo\n" * (i % 9))
    (tmp_path / "a0" / "_hidden").mkdir()
    (tmp_path / "a0" / "_hidden" / "c.txt").write_text("no\n")
    (tmp_path / "a0" / "other.md").write_text("no\n")
    monkeypatch.setattr(splits, "_load", lambda *a, **k: pytest.fail("a list of files in the driver"))
    monkeypatch.setattr(splits, "TASK_BYTES", 2000)
    lines = splits.numbered_splits(spark, str(tmp_path), split=16, suffix=".txt")
    assert sorted(lines.collect()) == sorted(read_lines(spark, f"{tmp_path}/a*/b*").select("session_key", "line", "text").collect())
    # Tasks get 2,000 bytes at most and about as much, but for the last one of each of four partitions.
    size = sum(9 * (i % 9) for i in range(150))
    assert size // 2000 <= lines.rdd.getNumPartitions() <= size // 1984 + 4
    assert splits.numbered_splits(spark, str(tmp_path / "a0" / "b0")).count() == 0


def test_sessions_are_put_in_place_by_tasks(spark, tmp_path):
    """Nothing by session comes back to the driver, no job of Spark's own writer runs, and each session is one whole file."""
    lines = spark.createDataFrame([(k, n, None if n == 3 else f"{k}é{n}") for k in ("1", "22", None) for n in range(5000)], "session_key string, line int, text string")
    session_files.write_sessions(lines.repartition(3, "session_key").sortWithinPartitions("session_key", "line"), f"file:{tmp_path}/out")
    found = {f.parent.name: f.read_text() for f in tmp_path.glob("out/deal=0000*/session_key=*/*")}
    assert found == {f"session_key={k or session_files.NO_KEY}": "".join("\n" if n == 3 else f"{k}é{n}\n" for n in range(5000)) for k in ("1", "22", None)}


def test_transcripts_pass_by_no_list_of_files(spark, monkeypatch):
    """What ``split_events_claude`` writes and reads again: whole lines, by tasks' folders, without a list in the driver."""
    monkeypatch.setattr(splits, "_load", lambda *a, **k: pytest.fail("a list of files in the driver"))
    root = transcript_files(spark, SF, "claude-code")
    lines = by_name(splits.numbered_splits(spark, root, split=16_384, suffix=".txt"))
    want = native.rich_lines(spark, SF, "claude-code")
    assert sorted(lines.select("session_key", "line", "text").collect()) == sorted(want.collect())
    files = [r["path"].rsplit("/", 3)[1:] for r in splits.files_below(spark, root).collect()]
    assert len(files) == want.select("session_key").distinct().count()
    assert all(deal.startswith("deal=") and name == "part-0.txt" for deal, _, name in files)


def test_small_pieces_of_growing_files_share_tasks():
    reader = GrowingReader("/t", ".txt", 65_536, 256 << 20)
    end = {"files": {f"/t/session_key={i}/part-0.txt": 100_000 for i in range(900)}}
    parts = reader.partitions({"files": {}}, end)
    assert sum(len(part.pieces) for part in parts) == 1800
    assert sum(p.end - p.start for part in parts for p in part.pieces) == 90_000_000
    assert len(parts) <= 90_000_000 // (4 << 20) + 3


def test_nested_records_are_not_read_again(monkeypatch):
    """A member's value is known from the record around it."""
    from scribeflow.functions import strict_json
    from scribeflow.sources import decode

    read = []
    loads = strict_json.loads
    monkeypatch.setattr(strict_json, "loads", lambda t: read.append(t) or loads(t))
    line = '{"type":"user","message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}'
    assert decode.claude_code(line)["items"][0]["user_message"]["content"][1]["text"] == "b"
    assert read == [line]
