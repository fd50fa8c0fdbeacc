"""A streaming source of files that grow: what each trigger adds to them, in pieces of bytes.

The offset is, for each file, the place after the last whole line that has been handed out. A trigger lists the
folder, looks for the last line feed of each file that is longer than its offset, and hands out the bytes between;
nothing before an offset is read again, also after a restart. Pieces of a file aren't cut at lines: whoever
reads them puts them in order by ``at``. A file that has become shorter is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .files import Piece, last_line_end, read_piece, walk

#: Bytes of one piece, and bytes of one file in one trigger; the rest follows in later triggers.
PIECE_BYTES, FILE_BYTES = 4 << 20, 256 << 20
#: What a task gets at least where pieces are smaller.
TASK_BYTES = 4 << 20


class _Part(InputPartition):
    def __init__(self, pieces: list[Piece]) -> None:
        super().__init__(0)
        self.pieces = pieces


class GrowingReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str, piece: int, most: int) -> None:
        self.root, self.suffix, self.piece, self.most = root, suffix, piece, most
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        ends = dict(self.known)
        for path, size in walk(self.root, self.suffix):
            start = ends.get(path, 0)
            if size > start:
                limit = min(size, start + self.most)
                end = last_line_end(path, start, limit)
                # A line longer than what a trigger takes is taken whole once it has ended.
                ends[path] = end if end > start or limit == size else last_line_end(path, start, size)
        self.known = {p: e for p, e in ends.items() if e}
        return {"files": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = {p: max(e, self.known.get(p, 0)) for p, e in end["files"].items()}
        parts: list[list[Piece]] = [[]]
        size = 0
        for path, to in sorted(end["files"].items()):
            at = start["files"].get(path, 0)
            while at < to:
                piece = Piece(path, at, min(to, at + self.piece))
                if size and size + piece.end - piece.start > max(self.piece, TASK_BYTES):
                    parts.append([])
                    size = 0
                parts[-1].append(piece)
                size += piece.end - piece.start
                at = piece.end
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for piece in partition.pieces:
            yield piece.path, piece.start, read_piece(piece)


class GrowingFiles(DataSource):
    """Options: path (a folder), suffix (of file names), pieceBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "session_key string, at long, data binary"

    def streamReader(self, schema: StructType) -> GrowingReader:
        o = self.options
        return GrowingReader(o["path"], o.get("suffix", ".jsonl"), int(o.get("pieceBytes", PIECE_BYTES)), int(o.get("fileBytes", FILE_BYTES)))
