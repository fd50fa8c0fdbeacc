"""Strict JSON with verbatim slices, which built-in functions can't give.

Built-in JSON functions accept trailing text, coerce types and write values anew; sizes and digests of
opaque payloads need the bytes as they stand. These helpers run inside Arrow batches.
"""

from __future__ import annotations

import json
import re
from datetime import datetime
from json.decoder import scanstring

_WS = re.compile(r"[ \t\r\n]*")
_BLANK = frozenset(" \t\r\n")
_TIME = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:\d{2})\Z")


class Mismatch(ValueError):
    """A value that is not of the type its field has."""


def _refuse(name: str):
    raise ValueError(f"invalid number {name}")


_DECODER = json.JSONDecoder(parse_constant=_refuse)
_scan = _DECODER.scan_once


def loads(text: str):
    return json.loads(text, parse_constant=_refuse) if text.startswith("\ufeff") else _DECODER.decode(text)


def _value(text: str, at: int) -> tuple[object, int]:
    try:
        return _scan(text, at)
    except StopIteration as e:
        raise json.JSONDecodeError("Expecting value", text, e.value) from None


def _past(text: str, at: int) -> int:
    """The place of the next character that is no white space; most often there is none."""
    return _WS.match(text, at).end() if text[at : at + 1] in _BLANK else at


def slices(text: str) -> dict[str, str]:
    """The members of a JSON object as verbatim text; of repeated keys the last counts."""
    out: dict[str, str] = {}
    at = _past(text, 0)
    if text[at : at + 1] != "{":
        raise Mismatch("not an object")
    at = _past(text, at + 1)
    if text[at : at + 1] == "}":
        return out
    while True:
        if text[at : at + 1] != '"':
            raise ValueError("expected a key")
        key, at = scanstring(text, at + 1, True)
        at = _past(text, at)
        if text[at : at + 1] != ":":
            raise ValueError("expected a colon")
        start = _past(text, at + 1)
        _, at = _value(text, start)
        out[key] = text[start:at]
        at = _past(text, at)
        if text[at : at + 1] == "}":
            return out
        if text[at : at + 1] != ",":
            raise ValueError("expected a comma")
        at = _past(text, at + 1)


def elements(text: str) -> list[str]:
    """The elements of a JSON array as verbatim text."""
    return [raw for raw, _ in parsed_elements(text)]


def parsed_elements(text: str) -> list[tuple[str, object]]:
    """The elements of a JSON array as verbatim text, each with its value."""
    at = _past(text, 0)
    if text[at : at + 1] != "[":
        raise Mismatch("not an array")
    at = _past(text, at + 1)
    out: list[tuple[str, object]] = []
    if text[at : at + 1] == "]":
        return out
    while True:
        start = at
        value, at = _value(text, start)
        out.append((text[start:at], value))
        at = _past(text, at)
        if text[at : at + 1] == "]":
            return out
        if text[at : at + 1] != ",":
            raise ValueError("expected a comma")
        at = _past(text, at + 1)


class Obj:
    """A JSON object read with typed accessors; null counts as absent, a wrong type raises.

    ``value``: what the text says, where that is known from the value around it.
    """

    def __init__(self, text: str, value: object = ...) -> None:
        value = loads(text) if value is ... else value
        if value is not None and not isinstance(value, dict):
            raise Mismatch("cannot read a value that is not an object")
        self.value: dict = value or {}
        self.text = text
        self._raw: dict[str, str] | None = None

    def raw(self, key: str) -> str | None:
        if self._raw is None:
            self._raw = slices(self.text) if self.value else {}
        return self._raw.get(key)

    def part(self, key: str) -> Obj:
        """A member that is there, as an object."""
        return Obj(self.raw(key), self.value[key])

    def _get(self, key: str, kind, zero):
        v = self.value.get(key)
        if v is None:
            return zero
        if not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool):
            raise Mismatch(f"field {key} has the wrong type")
        return v

    def str(self, key: str) -> str:
        return self._get(key, str, "")

    def bool(self, key: str) -> bool:
        return self._get(key, bool, False)

    def int(self, key: str) -> int:
        return self._get(key, int, 0)

    def maybe(self, key: str, kind):
        return self._get(key, kind, None)

    def obj(self, key: str) -> Obj:
        self._get(key, dict, None)
        return self.part(key) if self.value.get(key) is not None else Obj("{}", {})


def micros(text: str) -> int | None:
    """UTC microseconds of an RFC 3339 time; None for anything else."""
    m = _TIME.match(text)
    if not m:
        return None
    try:
        base = datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3]))
    except ValueError:
        return None
    return int(base.timestamp()) * 1_000_000 + int((m[2] or "0")[:6].ljust(6, "0"))
