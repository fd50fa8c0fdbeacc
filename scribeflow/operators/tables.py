"""The event table kept as Parquet: one folder a commit, partitioned by format, replaced session by session.

``commit`` writes the events of some sessions and the list of those sessions into a new folder and says so last, in a
marker file; a job that is killed before that leaves the table as it was. What a session held before counts no
longer once a later commit has it. ``compact`` writes what stands as one commit. Readers see committed
folders only, and of each session those rows that its latest commit wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import EVENTS

SESSIONS = "session_key string, harness string, commit long"
_STORED = T.StructType([*EVENTS.fields, T.StructField("commit", T.LongType()), T.StructField("harness", T.StringType())])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the commits that count, in order; a name for each commit, not their rows."""
    fs, where = _fs(spark, f"{table}/_commits")
    if not fs.exists(where):
        return []
    found = sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit())
    whole = [n for n in found if fs.exists(_fs(spark, f"{table}/_commits/{n}.all")[1])]
    return [n for n in found if not whole or n >= whole[-1]]


def commit(events: DataFrame, harness: str, table: str, sessions: DataFrame | None = None, whole: bool = False) -> int:
    """Writes events (or, with ``whole``, all that stands) as the next commit; its number.

    ``sessions`` (session_key): those that are replaced, where more than have events, such as ones that now end in an error.
    """
    spark = events.sparkSession
    fs, where = _fs(spark, f"{table}/_commits")
    fs.mkdirs(where)
    taken = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(where)]
    number = max(taken, default=0) + 1
    rows = events.withColumn("commit", F.lit(number).cast("long"))
    rows = rows if "harness" in rows.columns else rows.withColumn("harness", F.lit(harness))
    data = f"{table}/data/commit={number}"
    rows.drop("commit").write.mode("overwrite").option("compression", "zstd").partitionBy("harness").parquet(data)
    keys = spark.read.schema(T.StructType([f for f in _STORED.fields if f.name in ("session_key", "harness")])).parquet(data).select("session_key", "harness")
    if sessions is not None:
        keys = keys.unionByName(sessions.select("session_key", F.lit(harness).alias("harness")))
    keys.distinct().write.mode("overwrite").parquet(f"{table}/sessions/commit={number}")
    if whole:
        fs.create(_fs(spark, f"{table}/_commits/{number}.all")[1], True).close()
    fs.create(_fs(spark, f"{table}/_commits/{number}")[1], False).close()  # fails if another writer was faster
    return number


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The events that stand, with ``harness``; formats that a query doesn't ask for aren't opened."""
    numbers = commits(spark, table)
    if not numbers:
        return spark.createDataFrame([], _STORED).drop("commit")
    parts = [F.col("commit").isin(*numbers)]
    latest = spark.read.schema(SESSIONS).parquet(f"{table}/sessions").where(parts[0])
    latest = latest.withColumn("_n", F.row_number().over(Window.partitionBy("session_key", "harness").orderBy(F.desc("commit")))).where("_n = 1").drop("_n")
    rows = spark.read.schema(_STORED).parquet(f"{table}/data").where(parts[0])
    return rows.join(latest, ["session_key", "harness", "commit"], "left_semi").drop("commit")


def compact(spark: SparkSession, table: str) -> int:
    """All that stands as one commit; earlier ones count no longer, and their files can go."""
    return commit(read_table(spark, table), "", table, whole=True)
