"""Finding sessions under the roots of the agent tools, by path, identity and time window.

Listing runs in tasks, a folder each (``listing``). Paths are classified with regular expressions; identities
come from each transcript's first event, of which only the first bytes of a file are read.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_path, overlaps_window, safe_session_id
from ..plans.scratch import written
from .detect import REGISTRY
from .listing import session_files
from .splits import heads, key_of, numbered_splits
from .transcripts import decoded

#: Where each agent tool keeps its transcripts, under the home folder.
DEFAULT_ROOTS = {"antigravity": ".gemini/antigravity-cli/brain", "claude-code": ".claude/projects", "codex": ".codex/sessions"}
_TRANSCRIPT = "/.system_generated/logs/transcript_full.jsonl"


@dataclass
class Found:
    """References, skipped files with the reason, and files whose identity can't be read."""

    refs: DataFrame
    skips: DataFrame
    errors: DataFrame


def default_root(harness: str) -> str:
    return os.path.join(os.path.expanduser("~"), DEFAULT_ROOTS[harness])


def list_files(spark: SparkSession, root: str, hidden: str | None = None) -> DataFrame:
    """(path, rel, mtime_us, length) of all files below a root, contents unread.

    Listing passes over names that start with a dot; ``hidden`` is a pattern of such files to list too.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = reader.load(root).select("path", "modificationTime", "length")
    if hidden:
        try:
            files = files.unionByName(reader.load(f"{root.rstrip('/')}/{hidden}").select("path", "modificationTime", "length"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    clean = F.regexp_replace("path", r"^file:/*", "/")
    base = os.path.abspath(root.removeprefix("file:")).rstrip("/") + "/"
    return files.select("path", F.substring(clean, len(base) + 1, 1 << 20).alias("rel"), F.unix_micros("modificationTime").alias("mtime_us"), "length")


def classify(files: DataFrame, harness: str) -> DataFrame:
    """Adds role (main, subagent or NULL), stem (what subagents share with their session) and reason (of a skip)."""
    rel = F.col("rel")
    if harness == "claude-code":
        main, agent = rel.rlike(r"^[^/]+/[^/]+\.jsonl$"), rel.rlike(r"^[^/]+/[^/]+/subagents/agent-[^/]*\.jsonl$")
        reason = (
            F.when(~rel.contains("/"), "not a project directory")
            .when(rel.rlike(r"^[^/]+/[^/]+$"), "not a session transcript")
            .when(rel.rlike(r"^[^/]+/[^/]+/subagents/"), "not a subagent transcript")
            .otherwise("session directory sidecar")
        )
        stem = F.regexp_extract(rel, r"^([^/]+/[^/]+?)(?:\.jsonl)?(?:/|$)", 1)
    elif harness == "codex":
        main, agent = rel.rlike(r"(^|/)rollout-[^/]*\.jsonl$"), F.lit(False)
        reason, stem = F.lit("not a session transcript"), rel
    else:
        main, agent = F.concat(F.lit("/"), rel).rlike(r"^/[^/]+" + _TRANSCRIPT.replace(".", r"\.") + "$"), F.lit(False)
        stem = F.regexp_extract(rel, "^([^/]+)/", 1)
        reason = F.when(~rel.contains("/"), "not a conversation directory").otherwise("conversation sidecar")
    if "problem" in files.columns:
        lost = F.when(rel.rlike(r"^[^/]+/[^/]+/subagents$"), "unreadable subagents directory").when(rel.rlike(r"^[^/]+/[^/]+$"), "unreadable session directory").otherwise("unreadable directory")
        lost = lost if harness == "claude-code" else F.lit("unreadable directory")
        broken = F.col("problem").isNotNull()
        main, agent, reason = main & ~broken, agent & ~broken, F.when(broken, lost).otherwise(reason)
    role = F.when(main, "main").when(agent, "subagent")
    out = files.withColumn("role", role).withColumn("stem", stem).withColumn("reason", F.when(role.isNull(), reason))
    if harness == "antigravity":
        have = out.where("role = 'main'").select(F.col("stem").alias("_s")).distinct()
        out = out.join(have, F.col("stem") == F.col("_s"), "left")
        out = out.withColumn("reason", F.when(F.col("role").isNull() & (F.col("stem") != "") & F.col("_s").isNull() & ~F.col("reason").startswith("unreadable"), "conversation directory without transcript").otherwise(F.col("reason"))).drop("_s")
    return out


def in_day_window(rel: Column, since_us: int | None, until_us: int | None) -> Column:
    """False only for files in YYYY/MM/DD directories a whole day or more outside the window."""
    day = F.unix_micros(F.try_to_timestamp(F.regexp_extract(rel, r"^(\d{4}/\d{2}/\d{2})/", 1), F.lit("yyyy/MM/dd")))
    one = 86_400_000_000
    out = F.lit(False)
    if since_us is not None:
        out = out | (day + 2 * one < since_us)
    if until_us is not None:
        out = out | (day - one > until_us)
    return ~F.coalesce(out, F.lit(False))


#: Lines of a transcript that are decoded to find out whose it is, before more are.
HEAD_LINES = 32


def identities(lines: DataFrame, harness: str) -> DataFrame:
    """(session_key, meta, started_us, problem): the first record that can be an event, by transcript.

    The first lines are decoded alone; the rest only of transcripts that have no event there. Steps may come in
    any order, so that all of a stepwise transcript's lines are looked at.
    """
    if harness == "antigravity":
        return _first_events(decoded(lines, harness), F.struct(F.coalesce("step", F.lit(2**62)), F.col("line")))
    head = _first_events(decoded(lines.where(F.col("line") <= HEAD_LINES), harness), F.col("line"))
    late = lines.where(F.col("line") > HEAD_LINES).join(head.select("session_key"), "session_key", "left_anti")
    return head.unionByName(_first_events(decoded(late, harness), F.col("line")))


#: Bytes of a file that are read first to find its identity; those without an event there are read sixteen times as far, and so on.
HEAD_BYTES = 64 * 1024


def head_identities(spark: SparkSession, files: list[tuple[str, int]], harness: str) -> DataFrame:
    """``identities`` of (path, size) files from as few bytes as it takes, whatever their sizes.

    Steps may come in any order, so that stepwise transcripts are read whole.
    """
    if harness == "antigravity":
        return identities(numbered_splits(spark, *(p for p, _ in files)), harness)
    out, most = None, HEAD_BYTES
    while files:
        found = written(_first_events(decoded(heads(spark, files, most), harness), F.col("line")), "identities")
        out = found if out is None else out.unionByName(found)
        longer = [x for x in files if x[1] > most]
        if not longer:
            break
        keys = spark.createDataFrame([(key_of(p), p, n) for p, n in longer], "session_key string, path string, size long")
        files = [(r["path"], r["size"]) for r in keys.join(found.select("session_key"), "session_key", "left_anti").collect()]
        most *= 16
    return out


def _first_events(rows: DataFrame, order: Column) -> DataFrame:
    return rows.where("skip is null").groupBy("session_key").agg(*(F.min_by(c, order).alias(n) for c, n in (("meta", "meta"), ("ts_us", "started_us"), ("problem", "problem"))))


def references(files: DataFrame) -> DataFrame:
    """(stem, path, mtime_us, length, subagent_paths) of classified files: sessions with their subagents' paths.

    A session directory without its transcript leaves its subagents to stand for themselves.
    """
    none = F.array().cast("array<string>")
    agents = files.where("role = 'subagent'")
    lists = agents.groupBy("stem").agg(F.array_sort(F.collect_list("path")).alias("subagent_paths"))
    mains = files.where("role = 'main'").select("stem", "path", "mtime_us", "length")
    lone = agents.join(mains.select("stem"), "stem", "left_anti").select("stem", "path", "mtime_us", "length", none.alias("subagent_paths"))
    return mains.join(lists, "stem", "left").withColumn("subagent_paths", F.coalesce("subagent_paths", none)).unionByName(lone)


def oldest_first(refs: DataFrame) -> DataFrame:
    """Adds ``age_ord`` from 0: the oldest file first, equal times in order of their paths."""
    return refs.withColumn("age_ord", (F.row_number().over(Window.partitionBy("harness").orderBy("mtime_us", "path")) - 1).cast("long"))


def named(path: Column, harness: str, session_id: str) -> Column:
    """Whether a transcript's path is that of a session id."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"claude-code": name == f"{session_id}.jsonl", "codex": name.endswith(f"-{session_id}.jsonl"), "antigravity": path.contains(f"/{session_id}{_TRANSCRIPT}")}[harness]


def scan(spark: SparkSession, root: str, harness: str, since_us: int | None = None, until_us: int | None = None, only: Column | None = None) -> Found:
    """Sessions of one agent tool under a root; files outside the window, or not ``only``, are not opened."""
    empty = spark.createDataFrame([], "path string, reason string")
    refs_schema = "harness string, path string, session_id string, cwd string, git_branch string, harness_version string, is_subagent boolean, started_us long, mtime_us long, length long, subagent_paths array<string>"
    if not os.path.isdir(root.removeprefix("file:")) and "://" not in root:
        return Found(spark.createDataFrame([], refs_schema), spark.createDataFrame([(root, "root does not exist")], "path string, reason string"), empty)
    files = classify(written(session_files(spark, root, harness == "codex", since_us, until_us), "files"), harness)
    refs = references(files)
    # Copies keep old times, and old files may be written again: start and time both count, once they are known.
    refs = refs if only is None else refs.where(only)
    names = [(r["path"], r["length"]) for r in refs.select("path", "length").toLocalIterator()]  # paths to open: the listing, not the contents
    if not names:
        return Found(spark.createDataFrame([], refs_schema), files.where("reason is not null").select("path", "reason"), empty)
    known = head_identities(spark, names, harness).withColumnRenamed("session_key", "_k")
    keys = spark.createDataFrame([(p, key_of(p)) for p, _ in names], "path string, _k string")
    both = refs.join(keys, "path").join(known, "_k", "left")
    bad = both.where(F.col("meta").isNull() | F.col("problem").isNotNull())
    ident = F.col("stem") if harness == "antigravity" else F.col("meta.session_id")
    good = both.where(F.col("meta").isNotNull() & F.col("problem").isNull()).select(
        F.lit(harness).alias("harness"), "path", ident.alias("session_id"), "meta.cwd", "meta.git_branch", "meta.harness_version", F.coalesce("meta.is_subagent", F.lit(False)).alias("is_subagent"), "started_us", "mtime_us", "length", "subagent_paths"
    )
    good = good.where(overlaps_window(F.col("started_us"), F.col("mtime_us"), since_us, until_us))
    return Found(good, files.where("reason is not null").select("path", "reason"), bad.select("path", F.coalesce("problem", F.lit("no events in transcript")).alias("reason")))


def scan_all(spark: SparkSession, roots: dict[str, str] | None = None, since_us: int | None = None, until_us: int | None = None) -> Found:
    """Every agent tool's root in registry order; a missing root is a skip."""
    parts = [scan(spark, (roots or {}).get(h) or default_root(h), h, since_us, until_us) for h in REGISTRY]
    out = parts[0]
    for p in parts[1:]:
        out = Found(out.refs.unionByName(p.refs), out.skips.unionByName(p.skips), out.errors.unionByName(p.errors))
    return out


def locate(spark: SparkSession, root: str, harness: str, session_id: str) -> DataFrame:
    """The one session of an id: none and several are errors, and its own id must agree."""
    if not spark.range(1).select(safe_session_id(F.lit(session_id))).first()[0]:
        raise ValueError(f"invalid session id {session_id!r}")
    # The name decides which files are opened at all; what they say of themselves must agree.
    refs = scan(spark, root, harness, only=named(F.col("path"), harness, session_id)).refs
    rows = refs.limit(3).collect()
    if not rows:
        raise FileNotFoundError(f"{harness}: no transcript for session {session_id!r} under {root}")
    if len(rows) > 1:
        raise ValueError(f"{harness}: session {session_id!r} is ambiguous: {len(rows)} transcripts")
    if rows[0]["session_id"] != session_id:
        raise ValueError(f"{harness}: transcript {rows[0]['path']} says it is session {rows[0]['session_id']!r}")
    return refs


def located(spark: SparkSession, root: str, harness: str, session_id: str, since_us: int | None = None, until_us: int | None = None) -> Found:
    """The session of an id, if it was active within the window; only its own transcript is opened."""
    refs = locate(spark, root, harness, session_id).where(overlaps_window(F.col("started_us"), F.col("mtime_us"), since_us, until_us))
    none = spark.createDataFrame([], "path string, reason string")
    return Found(refs, none, none)


def filtered(refs: DataFrame, session_id: str | None, cwd: str | None) -> DataFrame:
    """Adds ``filter_reason``: NULL for a match, else the first filter that a session fails."""
    clean = clean_path(F.col("cwd"))
    no_cwd = F.coalesce("cwd", F.lit("")) == ""
    want = os.path.normpath(cwd) if cwd else None
    reason = F.lit(None).cast("string")
    if want:
        reason = F.when(no_cwd, "no recorded cwd").when(clean != want, "cwd")
    if session_id:
        reason = F.when(~F.col("session_id").eqNullSafe(session_id), "session id").otherwise(reason)
    return refs.withColumn("filter_reason", reason)


def summary(refs: DataFrame) -> DataFrame:
    """One row: sessions that match, that filters leave out, and among those the ones without a cwd."""
    reason = F.col("filter_reason")
    return refs.agg(F.count_if(reason.isNull()).alias("matched"), F.count_if(reason.isNotNull()).alias("filtered"), F.count_if(reason == "no recorded cwd").alias("no_cwd"))


def parse_when(text: str, until: bool = False) -> int:
    """Microseconds of an RFC 3339 time or a local date; the end of a date is 24 hours later."""
    try:
        if len(text) == 10:
            day = datetime.strptime(text, "%Y-%m-%d").astimezone()
            return int((day + (timedelta(hours=24) if until else timedelta())).timestamp() * 1e6)
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
        if when.tzinfo is None:
            raise ValueError
        return int(when.astimezone(UTC).timestamp() * 1e6)
    except ValueError:
        raise ValueError(f"cannot read {text!r} as a time: want RFC 3339 or YYYY-MM-DD") from None


__all__ = ["Found", "classify", "filtered", "identities", "locate", "oldest_first", "parse_when", "references", "scan", "scan_all", "summary"]
