"""Adapters by name: each turns numbered lines of one format into events, skips and errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from . import discover
from .detect import REGISTRY
from .discover import Found
from .transcripts import Options, Parsed, parse


class Adapter(Protocol):
    name: str

    def events(self, lines: DataFrame, options: Options = ...) -> Parsed: ...


class Locator(Protocol):
    """Finds an agent tool's sessions; what ``discover`` does for the formats of this library."""

    name: str

    def default_root(self) -> str: ...

    def scan(self, spark: SparkSession, root: str, since_us: int | None = None, until_us: int | None = None) -> Found: ...

    def locate(self, spark: SparkSession, root: str, session_id: str) -> DataFrame: ...


@dataclass(frozen=True)
class Native:
    """An adapter and locator of this library."""

    name: str

    def default_root(self) -> str:
        return discover.default_root(self.name)

    def scan(self, spark: SparkSession, root: str, since_us: int | None = None, until_us: int | None = None) -> Found:
        return discover.scan(spark, root, self.name, since_us, until_us)

    def locate(self, spark: SparkSession, root: str, session_id: str) -> DataFrame:
        return discover.locate(spark, root, self.name, session_id)

    def events(self, lines: DataFrame, options: Options = Options()) -> Parsed:
        return parse(lines, self.name, options)


ADAPTERS: dict[str, Adapter] = {name: Native(name) for name in REGISTRY}
LOCATORS: dict[str, Locator] = {name: Native(name) for name in REGISTRY}


def adapter_for(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise ValueError(f"unknown harness {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def locator_for(name: str) -> Locator:
    if name not in LOCATORS:
        raise ValueError(f"no locator for harness {name!r}; known: {', '.join(sorted(LOCATORS))}")
    return LOCATORS[name]


def parse_with(lines: DataFrame, name: str, options: Options = Options(), *transforms: Callable[[DataFrame], DataFrame]) -> Parsed:
    """Parses and then applies event-table transforms in order."""
    found = adapter_for(name).events(lines, options)
    for t in transforms:
        found.events = found.events.transform(t)
    return found
