"""The stored event table: commits replace sessions, and a job that dies midway changes nothing."""

import pytest
from fixtures import CLAUDE, CODEX

from scribeflow.operators import tables
from scribeflow.plans.schema import EVENTS
from scribeflow.sources.lines import lines_of
from scribeflow.sources.transcripts import parse


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*EVENTS.names).collect())


def test_commits_replace_sessions(spark, tmp_path, monkeypatch):
    table = f"file:{tmp_path}/t"
    assert tables.read_table(spark, table).count() == 0
    half = "\n".join(CLAUDE.splitlines()[:4]) + "\n"
    first = parse(lines_of(spark, {"a": half, "b": CLAUDE}), "claude-code").events
    assert tables.commit(first, "claude-code", table) == 1
    other = parse(lines_of(spark, {"a": CODEX}), "codex").events
    tables.commit(other, "codex", table)
    assert rows(tables.read_table(spark, table)) == rows(first.unionByName(other))
    grown = parse(lines_of(spark, {"a": CLAUDE}), "claude-code").events

    def dies(*a):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr("pyspark.sql.classic.dataframe.DataFrame.distinct", dies)  # when the data is there already
        with pytest.raises(OSError, match="killed"):
            tables.commit(grown, "claude-code", table)
    before = rows(first.unionByName(other))
    assert rows(tables.read_table(spark, table)) == before
    tables.commit(grown, "claude-code", table)
    want = rows(first.where("session_key = 'b'").unionByName(grown).unionByName(other))
    assert rows(tables.read_table(spark, table)) == want
    plan = tables.read_table(spark, table).where("harness = 'codex'")._jdf.queryExecution().executedPlan().toString()
    assert "harness" in plan.split("PartitionFilters")[1].split("]")[0]
    gone = spark.createDataFrame([("b",)], "session_key string")
    tables.commit(grown.limit(0), "claude-code", table, gone)
    want = rows(grown.unionByName(other))
    assert rows(tables.read_table(spark, table)) == want
    tables.compact(spark, table)
    assert rows(tables.read_table(spark, table)) == want and len(tables.commits(spark, table)) == 1
