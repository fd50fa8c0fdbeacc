"""Opening and listing files by path or URI, for the parts of reading that need places in a file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths and ``file:`` are local."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    local = path.removeprefix("file:")
    return pafs.LocalFileSystem(), "/" + local.lstrip("/") if path.startswith("file:") else os.path.abspath(local)


@dataclass(frozen=True)
class Piece:
    """Part of a file in bytes."""

    path: str
    start: int
    end: int


def read_piece(piece: Piece) -> bytes:
    fs, path = file_system(piece.path)
    with fs.open_input_file(path) as f:
        return f.read_at(piece.end - piece.start, piece.start) if piece.end > piece.start else b""


def last_line_end(path: str, start: int, size: int, block: int = 65_536) -> int:
    """The place after the last line feed between two places, looked for from the end; ``start`` if there is none."""
    at = size
    while at > start:
        low = max(start, at - block)
        found = read_piece(Piece(path, low, at)).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return start


def walk(root: str, suffix: str = "") -> Iterator[tuple[str, int]]:
    """(path, size) of the files below a folder, hidden ones too; nothing for a folder that isn't there."""
    fs, base = file_system(root)
    prefix = root[: len(root) - len(base)] if "://" in root and root.endswith(base) else ""
    for info in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        if info.type == pafs.FileType.File and info.path.endswith(suffix):
            yield prefix + info.path, info.size


def below(path: str, suffix: str = "", deep: bool = True) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a folder) of a file, or of the files below a folder; nothing for a path that isn't there.

    Below folders, names with a dot or a line in front are passed over, as by Spark's readers. Without ``deep`` the
    folders in a folder are given instead of what lies in them.
    """
    fs, base = file_system(path)
    info = fs.get_file_info(base)
    if info.is_file:
        yield path, info.size, False
        return
    prefix = path[: len(path) - len(base)] if "://" in path and path.endswith(base) else ""
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if info.base_name[:1] in (".", "_"):
            continue
        if info.type == pafs.FileType.Directory:
            if deep:
                yield from below(prefix + info.path, suffix)
            else:
                yield prefix + info.path, 0, True
        elif info.type == pafs.FileType.File and info.path.endswith(suffix):
            yield prefix + info.path, info.size, False
