"""Numbered lines without a sort: line feeds are counted by split, summed up, and lines numbered where they are read.

``numbered_splits`` gives what ``lines.read_lines`` gives, (session_key, line, text), with neither an exchange nor a
window: files that fit a split are numbered as they are read; of larger ones each split's line feeds are counted
by tasks first, so that every split knows the number of its first line. A line belongs to the split where
it starts. What lies below folders is listed by tasks and split in a table below the checkpoint folder, of which the
driver knows a name for each task. ``heads`` reads only the first bytes of files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..plans.scratch import folder, written
from .files import Piece, below, file_system, read_piece
from .lines import BOM, MAX_LINE_BYTES, TRIM

#: Bytes of a split, and what a task gets at least where splits are smaller.
SPLIT_BYTES, TASK_BYTES = 32 << 20, 8 << 20
LINES = "session_key string, line int, text string"
COUNTS = "path string, start long, feeds long"
PIECES = ["path", "start", "end", "size", "before"]
_BLOCK = 1 << 20


def key_of(path: str) -> str:
    """A session's key as Spark's own readers name a file."""
    if "://" in path and not path.startswith("file:"):
        return path
    return "file:" + "".join(quote(c, safe="/!$&'()*+,;=:@~-._") if c.isascii() else c for c in file_system(path)[1])


class _Part(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int, int, int, bool]]) -> None:
        super().__init__(0)
        self.pieces = pieces


def _rows(batch: list[tuple[str, int, str]]) -> pa.RecordBatch:
    keys, numbers, texts = zip(*batch)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["session_key", "line", "text"])


def lines_of_split(path: str, start: int, end: int, size: int, feeds: int, cut: bool = False) -> Iterator[tuple[int, str]]:
    """(line, text) of the non-blank lines that start in [start, end) of a file of ``size`` bytes, trimmed.

    ``feeds``: line feeds before ``start``. ``cut``: the file goes on behind ``size``, so that a line under way there isn't one.
    """
    fs, local = file_system(path)
    with fs.open_input_file(local) as f:
        at, number = start, feeds + 1
        if start:  # the line under way at the split's start belongs to a split before
            at = start - 1
            while True:
                data = f.read_at(min(_BLOCK, size - at), at) if at < size else b""
                if not data:
                    return
                found = data.find(b"\n")
                if found >= 0:
                    at += found + 1
                    number += at > start  # the one just before the split is among ``feeds``
                    break
                at += len(data)
        begin, begun, long = at, [], 0
        while begin < end:
            data = f.read_at(min(_BLOCK, size - at), at) if at < size else b""
            at += len(data)
            begun.append(data)
            long += len(data)
            if data and b"\n" not in data:
                if long > MAX_LINE_BYTES + _BLOCK:
                    raise ValueError("a line is longer than the limit")
                continue
            parts = b"".join(begun).split(b"\n")
            if data:
                begun = [parts.pop()]
                long = len(begun[0])
            elif cut or not parts[-1]:  # the end, with nothing behind the last line feed
                parts.pop()
            for raw in parts:
                if begin >= end:
                    return
                if len(raw) > MAX_LINE_BYTES:
                    raise ValueError("a line is longer than the limit")
                text = raw.decode("utf-8", "replace")
                text = (text.removeprefix(BOM) if number == 1 else text).strip(TRIM)
                if text:
                    yield number, text
                number += 1
                begin += len(raw) + 1
            if not data:
                return


def feeds_of(path: str, start: int, end: int) -> int:
    """Line feeds in [start, end) of a file."""
    return sum(read_piece(Piece(path, at, min(end, at + _BLOCK))).count(b"\n") for at in range(start, end, _BLOCK))


def lines_of_pieces(pieces: Iterable[tuple[str, int, int, int, int, bool]]) -> Iterator[pa.RecordBatch]:
    """The lines of pieces (path, start, end, size, feeds before, cut) in batches."""
    batch: list[tuple[str, int, str]] = []
    held = 0
    for path, start, end, size, feeds, cut in pieces:
        key = key_of(path)
        for number, text in lines_of_split(path, start, end, size, feeds, cut):
            batch.append((key, number, text))
            held += len(text)
            if held > 2_000_000 or len(batch) >= 10_000:
                yield _rows(batch)
                batch, held = [], 0
    if batch:
        yield _rows(batch)


class SplitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = [tuple(x) for x in json.loads(options["files"])]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.feeds = json.loads(options.get("feeds", "{}"))
        self.counting = options.get("counting", "false") == "true"
        self.head = int(options.get("head", 0))

    def __getstate__(self) -> dict:
        """What tasks need: the list of files grows with the input and would go to every one of them."""
        return self.__dict__ | {"files": [], "feeds": {}}

    def partitions(self) -> list[InputPartition]:
        """Splits of large files; small files and small splits share a task."""
        parts: list[list] = [[]]
        held = 0
        most = max(self.split, TASK_BYTES)
        for path, size in self.files:
            known = self.feeds.get(path, [])
            size, cut = (min(size, self.head), size > self.head) if self.head else (size, False)
            before = 0
            for k, start in enumerate(range(0, size, self.split)):
                end = min(size, start + self.split)
                if held and held + end - start > most:
                    parts.append([])
                    held = 0
                parts[-1].append((path, start, end, size, before, cut))
                held += end - start
                before += known[k] if k < len(known) else 0
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if self.counting:
            n = [feeds_of(path, start, end) for path, start, end, *_ in partition.pieces]
            paths, starts = ([p[i] for p in partition.pieces] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(n, pa.int64())], names=["path", "start", "feeds"])
            return
        yield from lines_of_pieces(partition.pieces)


class NumberedLines(DataSource):
    """Options: files (JSON of [path, size]), splitBytes, feeds (JSON, line feeds by split), counting, head."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return COUNTS if self.options.get("counting") == "true" else LINES

    def reader(self, schema: StructType) -> SplitReader:
        return SplitReader({k.lower(): v for k, v in self.options.items()})


def _load(spark: SparkSession, files: list[tuple[str, int]], split: int, **options: str) -> DataFrame:
    spark.dataSource.register(NumberedLines)
    reader = spark.read.format("numbered_lines").option("files", json.dumps(files)).option("splitBytes", split)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def _dealt(df: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """Rows by columns; their number is kept, as short rows stand for much to read."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least), *by)


def files_below(spark: SparkSession, *paths: str, suffix: str = "") -> DataFrame:
    """(path, size) of files and of what lies below folders, listed by tasks: folders one level below ``paths`` are dealt out."""
    found = "path string, size long, folder boolean"

    def listed(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    rows = []
                    for row in below(path, suffix, deep):
                        rows.append(dict(zip(("path", "size", "folder"), row)))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return run

    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("folder", pa.bool_())])
    top = written(spark.createDataFrame([(p,) for p in paths], "path string").mapInArrow(listed(False), found), "listed")
    deep = _dealt(top.where("folder").select("path"), "path").mapInArrow(listed(True), found)
    return top.where("not folder").unionByName(deep).select("path", "size").dropDuplicates(["path"])


def split_table(spark: SparkSession, files: DataFrame, split: int) -> str:
    """A new folder with the splits of (path, size) files, their line feeds before and the tasks that read them."""
    files = written(files, "files")
    most = max(split, TASK_BYTES)
    n = (files.agg(F.sum("size")).first()[0] or 0) // most + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()  # behind a file's last split nothing is numbered
            feeds = [feeds_of(p, a, b) if b < z else 0 for p, a, b, z in zip(*(rows[c] for c in PIECES[:4]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(feeds, pa.int64())], names=[*PIECES[:4], "feeds"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = 0, 0
        for batch in batches:
            names = []
            for at, a, b in zip(*(batch.column(c).to_pylist() for c in ("at", "start", "end"))):
                if held and held + b - a > most:
                    held, task = 0, task + 1
                held += b - a
                names.append(f"{at}-{task}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECES), pa.array(names, pa.string())], names=[*PIECES, "task"])

    starts = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    pieces = _dealt(starts.select("path", "start", F.least(F.col("start") + split, "size").alias("end"), "size"), "path", "start", least=n)
    rows = pieces.mapInArrow(counted, "path string, start long, end long, size long, feeds long")
    above = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("feeds").over(above), F.lit(0).cast("long"))).select(*PIECES, F.spark_partition_id().alias("at"))
    root = f"{folder(spark)}/splits-{uuid.uuid4().hex}"
    rows.mapInArrow(packed, "path string, start long, end long, size long, before long, task string").write.partitionBy("task").parquet(root)
    return root


def _tasks(table: str) -> list[str]:
    fs, base = file_system(table)
    return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.startswith("task="))


def _table_lines(spark: SparkSession, table: str) -> DataFrame:
    """The lines of a ``split_table``: each task reads its own splits' places."""

    def pieces(task: str) -> Iterator[tuple[str, int, int, int, int, bool]]:
        fs, _ = file_system(table)
        for info in fs.get_file_info(pafs.FileSelector(task)):
            if info.base_name.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    found = pq.read_table(f, columns=PIECES)
                for row in zip(*(found[c].to_pylist() for c in PIECES)):
                    yield *row, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                yield from lines_of_pieces(pieces(_tasks(table)[n]))

    n = len(_tasks(table))
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(run, LINES)


def numbered_splits(spark: SparkSession, *paths: str, split: int = SPLIT_BYTES, suffix: str = "") -> DataFrame:
    """(session_key, line, text) of the non-blank lines of files and folders; see the module."""
    infos = [(p, fs.get_file_info(local)) for p in paths for fs, local in (file_system(p),)]
    if not all(i.is_file for _, i in infos):
        return _table_lines(spark, split_table(spark, files_below(spark, *paths, suffix=suffix), split))
    files = sorted({p: i.size for p, i in infos}.items())
    large = [x for x in files if x[1] > split]
    feeds: dict[str, list[int]] = {}
    if large:  # a number for each split of a large file comes back
        for r in sorted(_load(spark, large, split, counting="true").collect(), key=lambda r: (r["path"], r["start"])):
            feeds.setdefault(r["path"], []).append(r["feeds"])
    return _load(spark, files, split, feeds=json.dumps(feeds))


def heads(spark: SparkSession, files: list[tuple[str, int]], most: int) -> DataFrame:
    """(session_key, line, text) of the whole lines within the first ``most`` bytes of each file; no more is read."""
    return _load(spark, files, max(SPLIT_BYTES, most), head=str(most))
