"""Baselines: files of known formats are clean, changed ones aren't, and runs add up in any order."""

import json

import pytest
from fixtures import CLAUDE, jsonl

from scribeflow import cli
from scribeflow.operators import baselines, drift
from scribeflow.sources.lines import lines_of


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def categories(spark, texts, base):
    outcomes, _ = drift.scan(lines_of(spark, texts), base)
    return {r.session_key: r.category for r in outcomes.collect()}


def test_known_formats_are_clean(spark):
    """Keys that no decoder reads are no drift by the library's own baseline; new types and values are."""
    more = jsonl({"type": "user", "uuid": "z", "sessionId": "q", "message": {"content": "x", "unheardOf": {"a": 1}}, "alsoNew": [1]})
    odd = jsonl({"type": "assistant", "sessionId": "q", "uuid": "y", "message": {"id": "n", "content": [{"type": "tool_use", "id": "1", "name": "NeverSeen"}]}})
    step = jsonl({"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "created_at": "", "tool_calls": [{"name": "view_file"}], "unheardOf": 1})
    got = categories(spark, {"c": CLAUDE + more, "g": step, "v": CLAUDE + odd}, baselines.shipped(spark))
    assert got == {"c": "clean", "g": "clean", "v": "drift"}


def test_keys_count_by_a_baseline_from_files(spark):
    base = baselines.from_lines(lines_of(spark, {"c": CLAUDE}), "claude-code")
    changed = CLAUDE.replace('"cwd"', '"cwd2"', 1)
    assert categories(spark, {"same": CLAUDE, "changed": changed}, base) == {"same": "clean", "changed": "drift"}
    row = base.where("record_type = 'user' and facet = 'type'").first()
    assert row.first_version == row.last_version == "2.1.190"


def test_runs_add_up_in_any_order(spark):
    def run(version, key):
        text = jsonl({"type": "user", "version": version, "sessionId": "q", key: 1, "message": {"content": "x"}})
        return baselines.from_lines(lines_of(spark, {version: text}), "claude-code")

    runs = [run("2.10.0", "b"), run("2.9.1", "a"), run("2.9.10", "a")]
    rows = lambda df: {(r.value, r.first_version, r.last_version) for r in df.where("facet = 'key' and value in ('a', 'b', 'version')").collect()}
    want = {("a", "2.9.1", "2.9.10"), ("b", "2.10.0", "2.10.0"), ("version", "2.9.1", "2.10.0")}
    assert rows(baselines.merged(*runs)) == rows(baselines.merged(baselines.merged(runs[2], runs[0]), runs[1])) == want
    whole = lines_of(spark, {v: jsonl({"type": "user", "version": v, "sessionId": "q", k: 1, "message": {"content": "x"}}) for v, k in (("2.10.0", "b"), ("2.9.1", "a"), ("2.9.10", "a"))})
    assert rows(baselines.from_lines(whole, "claude-code")) == want


def test_baselines_from_located_sessions(spark, tmp_path, capsys):
    (tmp_path / "in" / "p" / "count-1" / "subagents").mkdir(parents=True)
    (tmp_path / "in" / "p" / "count-1.jsonl").write_text(CLAUDE)
    (tmp_path / "in" / "p" / "count-1" / "subagents" / "agent-a.jsonl").write_text(CLAUDE + jsonl({"type": "user", "sessionId": "q", "subOnly": 1, "message": {"content": "x"}}))
    (tmp_path / "in" / "p" / "notes.txt").write_text("no transcript")
    out = tmp_path / "base.json"
    assert cli.main(["drift", "baseline", "--harness", "claude-code", "--root", str(tmp_path / "in"), "-o", str(out)]) == 0
    assert "subOnly" in json.loads(out.read_text())["record_types"]["user"]["keys"]
    path = tmp_path / "new.jsonl"
    path.write_text(CLAUDE + jsonl({"type": "user", "sessionId": "q", "other": 1, "message": {"content": "x"}}))
    assert cli.main(["drift", "scan", str(path), "--baseline", str(out)]) == 1 and "key other is new" in capsys.readouterr().out
    more = tmp_path / "more.json"
    assert cli.main(["drift", "baseline", str(path), "--harness", "claude-code", "--baseline", str(out), "-o", str(more)]) == 0
    assert {"subOnly", "other"} <= set(json.loads(more.read_text())["record_types"]["user"]["keys"])
    assert cli.main(["drift", "scan", str(path), "--baseline", str(more)]) == 0
    assert cli.main(["drift", "scan"]) == 3 and cli.main(["drift", "baseline", "--harness", "codex", "--root", str(tmp_path / "none")]) == 3
