"""Shared pieces of the training-data operators: scratch tables, tokenising, hashing.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir``, which the
driver and every executor share, so that work already done survives a lost executor.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LOCAL_ROOT: list[str] = []

#: ASCII white space; words are the runs of anything else. ``bytes.split`` cuts at just these.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = (
    np.uint64(0x9E3779B97F4A7C15),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0xD6E8FEB86659FD93),
    np.uint64(0xA0761D6478BD642F),
)


def scratch_root(spark: SparkSession) -> str:
    """The session's shared scratch folder; a temporary one only in single-process local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="scribeflow-"))
    return _LOCAL_ROOT[0]


class Scratch:
    """Written tables of one query run; each can be dropped once a later one replaces it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _folders(self, names: tuple[str, ...]) -> Iterator[tuple]:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            yield path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def make(self, *names: str) -> None:
        """Folders that a write by partitions leaves out where a partition has no rows; they read as empty tables."""
        for system, path in self._folders(names):
            system.mkdirs(path)

    def drop(self, *names: str) -> None:
        for system, path in self._folders(names):
            system.delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_C = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _C is not None:
        _C.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run`` for Arrow batches, which gives memory back at a task's end, as workers live on for other tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return tidied


#: Bytes of the Arrow batches that tasks get, where the session leaves the setting at its default.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | T.StructType, *forget: Callable[[], None]) -> DataFrame:
    """``mapInArrow`` in batches of about 2 MB, so that long texts don't fill the workers' memory; see ``tidy``."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, "67108864b") == "67108864b":
        conf.set(BATCH_BYTES, "2m")
    return df.mapInArrow(tidy(run, *forget), schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, mb: float = 2.0, forget: tuple[Callable[[], None], ...] = ()) -> DataFrame:
    """Runs ``fn`` over slices of about ``mb`` MB of Arrow batches; it yields dicts of columns for ``schema``. ``forget``: called at a task's end."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, mb=mb):
                for columns in fn(piece):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in out],
                        schema=out,
                    )

    return mapped(df, run, schema, *forget)


def slices(batch: pa.RecordBatch, rows: int = 1000, mb: float = 4.0) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ``rows`` rows and about ``mb`` MB, one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(rows, int(mb * 1e6 * n / max(batch.nbytes, 1))))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows5(hashes: np.ndarray) -> np.ndarray:
    """A hash for each window of five words, in order."""
    n = len(hashes) - 4
    total = hashes[:n] * _STEP[0]
    for i in range(1, 5):
        total += mix(hashes[i : n + i] + _STEP[i]) * _STEP[i]
    return mix(total)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < 5:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=5)], np.uint64)
    return np.unique(windows5(word_hashes(words)))


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
