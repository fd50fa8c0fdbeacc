"""Command line: detect, convert, stats, sessions and drift."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import LAST_VALIDATED
from .operators import acp, baselines, drift, promote, sinks
from .sources import discover
from .sources.detect import REGISTRY, detect
from .sources.lines import lines_of, read_lines
from .sources.transcripts import Options, parse_one


def session() -> SparkSession:
    spark = SparkSession.builder.appName("scribeflow").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, {"-": sys.stdin.read()}) if path == "-" else read_lines(spark, path)


def _harness(lines: DataFrame, wanted: str | None) -> str:
    if wanted and wanted not in REGISTRY:
        raise ValueError(f"unknown harness {wanted!r}; known: {', '.join(REGISTRY)}")
    found = detect(lines).first()
    if found is None:
        raise ValueError("the transcript is empty")
    if not wanted and found["harness"] is None:
        raise ValueError("no known format matches")
    return wanted or found["harness"]


@contextmanager
def _sink(out: str | None) -> Iterator[TextIO]:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            yield f
    else:
        yield sys.stdout


def _write(rows: DataFrame, out: str | None) -> None:
    """One value after another, never all of them at once."""
    with _sink(out) as f:
        for r in rows.toLocalIterator():
            f.write(r["value"] + "\n")


def _write_array(rows: DataFrame, out: str | None = None) -> None:
    """The values as one JSON array."""
    with _sink(out) as f:
        sep = "[\n"
        for r in rows.toLocalIterator():
            f.write(sep + json.dumps(json.loads(r["value"]), indent=2))
            sep = ",\n"
        f.write("[]\n" if sep[0] == "[" else "\n]\n")


def _detect(spark: SparkSession, a: argparse.Namespace) -> int:
    found = detect(_lines(spark, a.path)).first()
    if found is None or found["harness"] is None:
        raise ValueError("the transcript is empty" if found is None else "no known format matches")
    print(f"{found['harness']} ({found['confidence']})")
    return 0


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = _lines(spark, a.path)
    harness = _harness(lines, a.harness)
    transforms = promote.resolve(a.promote, harness)
    found = parse_one(lines, harness, Options(a.permissive, a.keep_raw, a.max_payload_bytes, a.version_hint))
    events = found.events
    for t in transforms:
        events = events.transform(t)
    if a.format == "json":
        _write(sinks.sessions_json(events), a.output)
    elif a.format == "acp":
        _write(sinks.acp_json(acp.acp_updates(events)).orderBy("seq", "block_idx"), a.output)
    else:
        _write(sinks.events_jsonl(events).orderBy("session_key", "seq"), a.output)
        counts = {r["record_type"]: r["count"] for r in found.skips.groupBy("record_type").count().collect()}
        print(sinks.skip_summary(events.count(), counts), file=sys.stderr)
    return 0


def _stats(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = _lines(spark, a.path)
    harness = _harness(lines, a.harness)
    events = parse_one(lines, harness, Options(permissive=a.permissive)).events
    for t in promote.resolve(a.promote, harness):
        events = events.transform(t)
    _write(sinks.stats_json(events), a.output)
    return 0


def _sessions(spark: SparkSession, a: argparse.Namespace) -> int:
    since = discover.parse_when(a.since) if a.since else None
    until = discover.parse_when(a.until, until=True) if a.until else None
    if a.root and not a.harness:
        raise ValueError("--root needs --harness")
    if a.harness and a.session_id:
        found = discover.located(spark, a.root or discover.default_root(a.harness), a.harness, a.session_id, since, until)
    elif a.harness:
        found = discover.scan(spark, a.root or discover.default_root(a.harness), a.harness, since, until)
    else:
        found = discover.scan_all(spark, None, since, until)
    refs = discover.filtered(found.refs, a.session_id, a.cwd)
    match = refs.where("filter_reason is null").drop("filter_reason")
    if a.format == "paths":
        _write(sinks.ref_paths(match), None)
    else:
        rows = match.orderBy("path").select(F.to_json(F.struct("*")).alias("value"))
        (_write_array if a.format == "json" else _write)(rows, None)
    n = discover.summary(refs).first()
    errors = found.errors.collect()
    for e in errors:
        print(f"{e['path']}: {e['reason']}", file=sys.stderr)
    no_cwd = f" ({n['no_cwd']} without recorded cwd)" if n["no_cwd"] else ""
    print(f"{n['matched']} sessions, {n['filtered']} filtered out{no_cwd}, {found.skips.count()} skipped files, {len(errors)} errors", file=sys.stderr)
    return 1 if errors else 0


def _drift(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.verb == "scan" and not a.paths:
        raise ValueError("drift scan needs files")
    lines = read_lines(spark, *a.paths) if a.paths else None
    if a.verb == "baseline":
        if not a.harness:
            raise ValueError("drift baseline needs --harness")
        if lines is None:  # the sessions of the tool itself
            words = baselines.from_root(spark, a.root or discover.default_root(a.harness), a.harness)
        else:
            own = detect(lines).where(F.col("harness") == a.harness).select("session_key")
            words = baselines.from_lines(lines.join(own, "session_key", "left_semi"), a.harness)
        if a.baseline:
            with open(a.baseline, encoding="utf-8") as f:
                words = baselines.merged(words, sinks.read_baseline(f.read(), spark))
        words = words.persist()
        if words.isEmpty():
            raise ValueError(f"none of the files is a {a.harness} transcript")
        _write(sinks.baseline_json(words, a.version or LAST_VALIDATED[a.harness]), a.output)
        return 0
    base = baselines.shipped(spark)
    if a.baseline:
        with open(a.baseline, encoding="utf-8") as f:
            own_base = sinks.read_baseline(f.read(), spark)
        base = base.join(own_base.select("harness").distinct(), "harness", "left_anti").unionByName(own_base)
    outcomes, report = drift.scan(lines, base)
    _write(report.orderBy("session_key", "rank", "line").select(F.col("line").alias("value")), a.output)
    return drift.EXIT_CODES[drift.worst([r["category"] for r in outcomes.select("category").distinct().collect()])]


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="scribeflow", description=__doc__)
    verbs = top.add_subparsers(dest="command", required=True)

    def verb(name: str, fn) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        p.set_defaults(run=fn)
        return p

    p = verb("detect", _detect)
    p.add_argument("path")
    for name, fn in (("convert", _convert), ("stats", _stats)):
        p = verb(name, fn)
        p.add_argument("path")
        p.add_argument("--harness")
        p.add_argument("--permissive", action="store_true")
        p.add_argument("--promote", action="append", default=[])
        p.add_argument("-o", "--output")
        if name == "convert":
            p.add_argument("--format", choices=("json", "jsonl", "acp"), default="json")
            p.add_argument("--keep-raw", action="store_true")
            p.add_argument("--max-payload-bytes", type=int, default=0)
            p.add_argument("--version-hint", default="")
    p = verb("sessions", _sessions)
    p.add_argument("--format", choices=("paths", "json", "jsonl"), default="paths")
    for name in ("cwd", "harness", "root", "session-id", "since", "until"):
        p.add_argument(f"--{name}")
    p = verb("drift", _drift)
    p.add_argument("verb", choices=("scan", "baseline"))
    p.add_argument("paths", nargs="*")
    p.add_argument("--harness", choices=REGISTRY)
    p.add_argument("--root", help="where to look for sessions to make a baseline of")
    p.add_argument("--baseline", help="a baseline file to use instead of the library's own, or to add to")
    p.add_argument("--version", default="")
    p.add_argument("-o", "--output")
    a = top.parse_args(argv)
    try:
        return a.run(session(), a)
    except (ValueError, OSError, AnalysisException) as e:
        print(f"scribeflow: {e}", file=sys.stderr)
        return drift.EXIT_CODES["exec-error"] if a.command == "drift" else 1


if __name__ == "__main__":
    sys.exit(main())
