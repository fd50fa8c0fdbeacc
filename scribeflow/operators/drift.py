"""Vocabulary of record types, keys and discriminator values, its drift from a baseline, and the scan of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import LAST_VALIDATED, version_newer
from ..plans.scratch import written
from ..sources.detect import REGISTRY, detect
from ..sources.transcripts import Options, decoded, parse
from .validate import uncovered_lines

#: Fixed values: (record type, path) pairs whose string values are part of the vocabulary; ``*`` is any type.
DISCRIMINATORS = {
    "antigravity": [("*", "source"), ("*", "tool_calls[].name")],
    "claude-code": [("assistant", "message.content[].type"), ("assistant", "message.content[].name"), ("user", "message.content[].type")],
    "codex": [("event_msg", "payload.type"), ("response_item", "payload.type"), ("response_item", "payload.name")],
}
UNTYPED = "(untyped)"
#: Severity order, the worst last, and the exit code of each category.
SEVERITY = ("clean", "inconclusive", "exec-error", "drift")
EXIT_CODES = {"clean": 0, "drift": 1, "inconclusive": 2, "exec-error": 3}


def _strings(values: Column) -> Column:
    """The strings among variants."""
    return F.transform(F.filter(values, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), lambda x: F.try_variant_get(x, "$", "string"))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def reached(v: Column, path: str) -> Column:
    """The strings that a dotted path reaches in a variant, as an array; ``[]`` walks an array."""
    now = F.array(v)
    for segment in path.split("."):
        key = segment.removesuffix("[]")
        now = F.transform(now, lambda x: F.try_variant_get(x, f"$.{key}", "variant"))  # noqa: B023
        if segment.endswith("[]"):
            now = F.flatten(F.transform(now, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))))
    return _strings(now)


def shaped(lines: DataFrame, harness: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """(seen, words): distinct (``by``, shape) of ``lines`` (text and ``by``), and the distinct (shape, record_type,
    facet, path, value) of the vocabulary.

    Two lines are of one shape if their type, their keys and what they have at the discriminators' paths are the same,
    so that a shape's words are those of any line of it: they are spelled for one text of each shape. ``lines`` is read twice.
    """
    rows = lines.select(*by, "text", F.try_parse_json("text").alias("v")).withColumn("record_type", _record_type(F.col("v")))
    at = [reached(F.col("v"), path) for _, path in DISCRIMINATORS[harness]]
    of = [F.schema_of_variant("v"), F.col("record_type"), *(x for a in at for x in (F.size(a), a))]
    shape = F.struct(F.xxhash64(*of).alias("a"), F.xxhash64(F.lit(1), *of).alias("b"))
    seen = written(rows.select(*by, shape.alias("shape"), F.xxhash64("text").alias("h")).groupBy(*by, "shape").agg(F.min("h").alias("h")), "shapes")
    one = written(seen.groupBy("shape").agg(F.min("h").alias("h")), "shape")
    texts = lines.select("text").join(one.select("h").distinct(), F.xxhash64("text") == F.col("h"), "left_semi").distinct()
    known = texts.select("text", F.try_parse_json("text").alias("v")).withColumn("record_type", _record_type(F.col("v"))).select("text", "v", shape.alias("shape"))
    known = known.join(one.select("shape"), "shape", "left_semi").groupBy("shape").agg(F.min("text").alias("text"))
    return seen.select(*by, "shape"), spelled(known, harness, "shape").distinct()


def _record_type(v: Column) -> Column:
    return F.coalesce(F.nullif(F.get(_strings(F.array(F.try_variant_get(v, "$.type", "variant"))), F.lit(0)), F.lit("")), F.lit(UNTYPED))


def spelled(lines: DataFrame, harness: str, *by: str) -> DataFrame:
    """(``by``, record_type, facet, path, value) of each line of ``lines`` (text and ``by``), which is parsed once."""
    rows = lines.select(*by, F.try_parse_json("text").alias("v")).withColumn("m", _fields(F.col("v")))
    rows = rows.withColumn("record_type", _record_type(F.col("v")))
    entry = lambda facet, path, value: F.struct(F.lit(facet).alias("facet"), F.lit(path).alias("path"), value.alias("value"))
    inner = F.flatten(F.transform(F.map_entries("m"), lambda e: F.concat(F.array(e["key"]), F.coalesce(F.transform(F.map_keys(_fields(e["value"])), lambda s: F.concat(e["key"], F.lit("."), s)), F.array().cast("array<string>")))))
    parts = [F.array(entry("type", "", F.lit(""))), F.transform(F.coalesce(inner, F.array().cast("array<string>")), lambda k: entry("key", "", k))]
    for of, path in DISCRIMINATORS[harness]:
        found = reached(F.col("v"), path)
        if path == "message.content[].name":  # tools that servers bring are one name
            found = F.transform(found, lambda x: F.when(x.startswith("mcp__"), "mcp__*").otherwise(x))
        found = found if of == "*" else F.when(F.col("record_type") == of, found)
        parts.append(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: entry("value", path, x)))  # noqa: B023
    out = rows.select(*by, "record_type", F.explode(F.array_distinct(F.concat(*parts))).alias("e"))
    return out.select(*by, "record_type", "e.facet", "e.path", "e.value")


def vocabulary(lines: DataFrame, harness: str, *by: str) -> DataFrame:
    """Distinct (``by``, harness, record_type, facet, path, value) of ``lines`` (text and ``by``).

    Facet ``type`` has one row for each record type, ``key`` its keys two levels deep, ``value`` the
    discriminator values.
    """
    seen, words = shaped(lines, harness, *by)
    out = seen.join(words, "shape") if by else words
    return out.select(*by, F.lit(harness).alias("harness"), "record_type", "facet", "path", "value").distinct()


def path_values(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``value``: the strings that a dotted path reaches; ``[]`` walks an array."""
    return rows.withColumn("value", F.explode(reached(F.try_parse_json("text"), path)))


def drift(baseline: DataFrame, observed: DataFrame, *by: str) -> DataFrame:
    """(``by``, harness, finding, record_type, path, value): what is new, and baseline types never seen.

    New keys and values count only for known record types, keys only where the baseline has keys of the type at all.
    Vocabularies are small: distinct names only.
    """
    on = ["harness", "record_type"]
    known = baseline.where("facet = 'type'").select(*on).distinct()
    types = observed.where("facet = 'type'")
    new_types = types.join(known, on, "left_anti")
    inner = observed.join(known, on, "left_semi").join(baseline.select(*on, "facet", "path", "value"), [*on, "facet", "path", "value"], "left_anti")
    wanted = types.select(*by, "harness").distinct().join(known, "harness") if by else known
    unseen = wanted.join(types.select(*by, *on), [*by, *on], "left_anti").withColumns({"path": F.lit(""), "value": F.lit("")})
    keyed = baseline.where("facet = 'key'").select(*on).distinct()
    inner = inner.where("facet <> 'key'").unionByName(inner.where("facet = 'key'").join(keyed, on, "left_semi").select(inner.columns))
    name = F.when(F.col("facet") == "key", "new_key").otherwise("new_value")
    pick = lambda df, f: df.select(*by, "harness", f.alias("finding"), "record_type", "path", "value")
    return pick(new_types, F.lit("new_record_type")).unionByName(pick(inner.where("facet <> 'type'"), name)).unionByName(pick(unseen, F.lit("unexercised")))


def file_findings(baseline: DataFrame, lines: DataFrame, harness: str) -> tuple[DataFrame, DataFrame]:
    """``drift`` by session_key in two parts, what is new and what never occurs: shapes are held against the baseline, not lines."""
    seen, words = shaped(lines, harness, "session_key")
    words = written(words.withColumn("harness", F.lit(harness)), "words")
    on = ["harness", "record_type", "facet", "path", "value"]
    new = drift(baseline, words.select(*on).distinct()).where("finding <> 'unexercised'")
    facet = F.when(F.col("finding") == "new_record_type", "type").when(F.col("finding") == "new_key", "key").otherwise("value")
    shapes = words.join(new.withColumn("facet", facet), on).drop("facet")
    found = ["session_key", "harness", "finding", "record_type", "path", "value"]
    types = seen.join(words.where("facet = 'type'"), "shape").select("session_key", *on).distinct()
    unseen = drift(baseline, types, "session_key").where("finding = 'unexercised'")
    return written(seen.join(shapes, "shape").select(*found).distinct(), "findings"), unseen.select(*found)


def finding_text() -> Column:
    return (
        F.when(F.col("finding") == "new_record_type", F.format_string("  drift: the baseline lacks record type %s", "record_type"))
        .when(F.col("finding") == "new_key", F.format_string("  drift: key %s is new in record type %s", "value", "record_type"))
        .when(F.col("finding") == "new_value", F.format_string("  drift: %s is new at %s of record type %s", "value", "path", "record_type"))
        .otherwise(F.format_string("  info: record type %s does not occur", "record_type"))
    )


def _rank() -> Column:
    return F.when(F.col("finding") == "new_record_type", 10).when(F.col("finding") == "new_key", 11).when(F.col("finding") == "new_value", 12).otherwise(20)


def report_lines(findings: DataFrame) -> DataFrame:
    """The findings as report text, sorted by kind and by byte order."""
    return findings.select(_rank().alias("rank"), "record_type", "path", "value", finding_text().alias("line")).orderBy("rank", "record_type", "path", "value").select("line")


def scan(lines: DataFrame, baseline: DataFrame, tasks: int = 0) -> tuple[DataFrame, DataFrame]:
    """Checks transcripts of any mixture of formats: (outcomes, report).

    ``lines``: session_key, line, text of all files. Outcomes have a row for each file: session_key, harness, category.
    Report: session_key, rank, line, in order of rank and line within a file. A file's format is detected;
    it is read strictly, every line has to be accounted for, and its vocabulary is held against the baseline.
    A failure of one file leaves the others alone. ``tasks``: as in ``Options``.
    """
    found = written(detect(lines).select("session_key", "harness"), "detected")
    note = lambda df, rank, text: df.select("session_key", F.lit(rank).alias("rank"), text.alias("line"))
    lost = found.where("harness is null")
    report = note(lost, 0, F.concat("session_key", F.lit(": no known format")))
    bad = lost.select("session_key", F.lit("exec-error").alias("category"))
    report = report.unionByName(note(found.where("harness is not null"), 0, F.concat_ws(": ", "session_key", "harness")))
    occurs = {r["harness"] for r in found.select("harness").distinct().collect()}  # a name for each format at most
    known = written(lines.select("session_key", "line", "text").join(found.where("harness is not null"), "session_key"), "known", "harness")
    for h in (h for h in REGISTRY if h in occurs):
        own = known.where(F.col("harness") == h)
        # Decoded once; errors, spans and versions each read the few columns that they need.
        read = parse(written(decoded(own, h, spans=True), "decoded"), h, Options(tasks=tasks))
        errors = written(read.errors, "errors")
        report = report.unionByName(note(errors, 1, F.format_string("  drift: line %d: %s", "line", "reason")))
        missed = uncovered_lines(own.join(errors.select("session_key"), "session_key", "left_anti"), read.events, read.skips)
        missed = written(missed.groupBy("session_key").agg(F.count("*").alias("n")), "missed")
        report = report.unionByName(note(missed, 2, F.format_string("  drift: %d lines are not accounted for", "n")))
        version = F.col("meta.harness_version")
        newer = read.events.where("kind = 'session_meta'").where(F.coalesce(version_newer(version, F.lit(LAST_VALIDATED[h])), F.lit(False)))
        newer = newer.select("session_key", version.alias("version")).unionByName(errors.where("newer").select("session_key", "version"))
        report = report.unionByName(note(newer, 3, F.format_string(f"  note: version %s was not validated; the newest that was is {LAST_VALIDATED[h]}", "version")))
        new, unseen = file_findings(baseline.where(F.col("harness") == h), own, h)
        for part in (new, unseen):
            report = report.unionByName(part.select("session_key", _rank().alias("rank"), finding_text().alias("line")))
        for part in (errors, missed, new):
            bad = bad.unionByName(part.select("session_key", F.lit("drift").alias("category")))
    worst_of = F.max(severity(F.col("category")))
    outcomes = found.join(bad.groupBy("session_key").agg(worst_of.alias("s")), "session_key", "left")
    outcomes = outcomes.select("session_key", "harness", F.get(F.array(*map(F.lit, SEVERITY)), F.coalesce("s", F.lit(0))).alias("category"))
    report = report.unionByName(note(outcomes.where("category = 'clean'"), 30, F.lit("  clean: as the baseline has it")))
    return outcomes, report


def severity(category: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), category).cast("int") - 1


def worst(categories: list[str]) -> str:
    """The most severe category; severity, not exit code, decides."""
    return max(categories, key=SEVERITY.index, default="clean")
