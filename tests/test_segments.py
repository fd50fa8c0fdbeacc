"""Operators over segments give what those over whole sessions give, wherever sessions are cut."""

import random

import pytest
from pyspark.sql import functions as F

from scribeflow.operators import segments, sequence
from scribeflow.plans.oracles import ORACLES
from scribeflow.plans.queries import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    pick = lambda p: rng.random() < p
    data = []
    for session, n in (("a", 1000), ("b", 37), ("c", 1), ("quiet", 60), ("d", 300)):
        busy = 0.0 if session == "quiet" else 1.0
        for i in range(n):
            flags = [pick(p * busy) if pick(0.9) else None for p in (0.1, 0.15, 0.4, 0.7)]
            data.append((session, i, *flags, rng.choice([None, 0, 1, 2, 5]), rng.choice(["x", "y", None]), rng.choice(["v", *[None] * 40])))
    return spark.createDataFrame(data, "session_key string, line long, o boolean, c boolean, t boolean, m boolean, n int, mid string, v string").cache()


CASES = {
    "carry_forward": lambda ops, r: ops.carry_forward(r, "v", "line", "now"),
    "fold_islands": lambda ops, r: ops.fold_islands(r, "mid", "line"),
    "fold_islands_among": lambda ops, r: ops.fold_islands(r, "mid", "line", F.col("m")),
    "closing_lines": lambda ops, r: ops.closing_lines(r, F.col("o"), F.col("c") | F.col("o"), "line"),
    "fifo_match": lambda ops, r: ops.fifo_match(r, F.col("o"), F.col("t"), F.col("n"), "line"),
}


@pytest.mark.parametrize("case", CASES)
def test_any_cut(rows, case):
    run = CASES[case]
    want = run(sequence, rows)
    names = [c for c in want.columns if not c.startswith("_")]
    want = sorted(map(str, want.select(names).collect()))
    # Segments of one row, of ten (a session of a thousand lines in a hundred), and one for all.
    for size in (1, 10, 64, 10_000):
        got = run(segments, segments.cut(rows, "line", size)).select(names)
        assert sorted(map(str, got.collect())) == want, size


@pytest.mark.parametrize("case", CASES)
def test_rows_are_never_grouped_by_session_alone(rows, case):
    """What is sorted by session alone comes from an aggregate by segment: windows of rows have the segment in their key."""
    plan = CASES[case](segments, segments.cut(rows, "line", 10))._jdf.queryExecution().analyzed().toString()
    lines = [x for x in plan.split("\n") if x.lstrip(" :+-").startswith("Window")]
    assert lines and all("segment#" in x for x in lines)


def test_queries_by_segment(spark):
    assert {f"segmented_{n}" for n in ("codex_usage_pool", "claude_fold", "antigravity_fifo", "model_carry_forward")} <= set(QUERIES) & set(ORACLES)
