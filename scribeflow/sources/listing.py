"""Listing session folders by tasks: a partition for each folder, day folders outside a window never opened.

Hidden files are listed too, and a folder that can't be read is a row of its own with its problem.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import file_system

FILES = "path string, rel string, mtime_us long, length long, problem string"
_DAY = re.compile(r"(\d{4})/(\d{2})/(\d{2})")
_MONTHS = re.compile(r"\d{4}(/\d{2})?")


def day_outside(rel: str, since_us: int | None, until_us: int | None) -> bool:
    """Whether a folder YYYY/MM/DD lies a whole day or more outside a window; other folders never do."""
    from datetime import UTC, datetime

    m = _DAY.fullmatch(rel)
    if not m:
        return False
    try:
        day = int(datetime(*map(int, m.groups()), tzinfo=UTC).timestamp()) * 1_000_000
    except ValueError:
        return False
    one = 86_400_000_000
    return since_us is not None and day + 2 * one < since_us or until_us is not None and day - one > until_us


def entries(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.base_name)


def below(fs: pafs.FileSystem, base: str, rel: str, opened=lambda rel: True) -> Iterator[tuple[str, int | None, int | None, str | None]]:
    """(rel, mtime_us, length, problem) of the files below a folder and of folders that can't be read."""
    try:
        found = entries(fs, f"{base}/{rel}" if rel else base)
    except OSError as e:
        yield rel, None, None, f"unreadable: {e.strerror or e}"
        return
    for info in found:
        inner = f"{rel}/{info.base_name}" if rel else info.base_name
        if info.type == pafs.FileType.Directory:
            if opened(inner):
                yield from below(fs, base, inner, opened)
        else:
            yield inner, info.mtime_ns // 1000 if info.mtime_ns is not None else None, info.size, None


class _Part(InputPartition):
    def __init__(self, rel: str, whole: bool) -> None:
        super().__init__(rel)
        self.rel, self.whole = rel, whole


class ListingReader(DataSourceReader):
    def __init__(self, root: str, days: bool, since_us: int | None, until_us: int | None) -> None:
        self.root, self.days, self.since_us, self.until_us = root.rstrip("/"), days, since_us, until_us

    def _opened(self, rel: str) -> bool:
        return not (self.days and day_outside(rel, self.since_us, self.until_us))

    def partitions(self) -> list[InputPartition]:
        """A partition for each top folder, or for each day folder, and one for the files beside them."""
        fs, base = file_system(self.root)
        parts, ask = [_Part("", False)], [""]
        while ask:
            rel = ask.pop()
            try:
                found = entries(fs, f"{base}/{rel}" if rel else base)
            except OSError:
                parts.append(_Part(rel, True))  # the task says what is wrong
                continue
            for info in found:
                inner = f"{rel}/{info.base_name}" if rel else info.base_name
                if info.type != pafs.FileType.Directory or not self._opened(inner):
                    continue
                if self.days and _MONTHS.fullmatch(inner):
                    ask.append(inner)
                    parts.append(_Part(inner, False))
                else:
                    parts.append(_Part(inner, True))
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        fs, base = file_system(self.root)
        prefix = f"{self.root}/" if "://" in self.root and not self.root.startswith("file:") else f"file:{base}/"
        opened = self._opened if partition.whole else lambda rel: False
        for rel, mtime_us, length, problem in below(fs, base, partition.rel, opened):
            yield prefix + rel, rel, mtime_us, length, problem


class SessionFiles(DataSource):
    """Options: path (a root), days (whether folders YYYY/MM/DD are left out), window (JSON of since and until in microseconds)."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"], self.options.get("days", "false") == "true", *json.loads(self.options.get("window", "[null, null]")))


def session_files(spark: SparkSession, root: str, days: bool = False, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """path, rel, mtime_us, length, problem of what lies below a root."""
    spark.dataSource.register(SessionFiles)
    return spark.read.format("session_files").option("days", str(days).lower()).option("window", json.dumps([since_us, until_us])).load(root)
