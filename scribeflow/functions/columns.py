"""Column functions that operators share: all built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3339 with a zone, the only form of time that counts.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_UNSAFE_ID = r"[/\\*?\[]|\.\."

#: The newest version of each agent tool whose format was validated.
LAST_VALIDATED = {"antigravity": "1.1.10", "claude-code": "2.1.212", "codex": "0.146.0"}


def parse_time(text: Column) -> Column:
    """UTC microseconds of an RFC 3339 time; NULL for anything else, never an error."""
    return F.when(text.rlike(RFC3339), F.unix_micros(F.try_to_timestamp(text)))


def ntz_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    gap = ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    part = lambda f: F.extract(F.lit(f), gap).cast("long")
    return part("DAY") * 86_400_000_000 + part("HOUR") * 3_600_000_000 + part("MINUTE") * 60_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def millis_between(start_us: Column, end_us: Column) -> Column:
    """Whole milliseconds, cut toward zero."""
    gap = end_us - start_us
    return F.when(gap >= 0, F.floor(gap / 1000)).otherwise(-F.floor(-gap / 1000)).cast("long")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def lookup(name: Column, table: Mapping[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(default)) if pairs else F.lit(default)


def blocks_text(blocks: Column) -> Column:
    """The non-empty text blocks, joined by line breaks."""
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: b["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def block_bytes(block: Column) -> Column:
    """A block's payload size: the recorded size where it was cut, else its text and raw bytes."""
    whole = F.coalesce(F.octet_length(block["text"]), F.lit(0)) + F.coalesce(F.octet_length(block["raw"]), F.lit(0))
    return F.when(F.coalesce(block["truncated"], F.lit(False)), F.coalesce(block["size"], F.lit(0))).otherwise(whole).cast("long")


def content_bytes(blocks: Column) -> Column:
    total = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + block_bytes(b))
    return F.coalesce(total, F.lit(0).cast("long"))


def truncate_block(block: Column, limit: int) -> Column:
    """A block whose text or raw is longer than ``limit`` bytes keeps size and digest in its place."""
    over = lambda c: F.coalesce(F.octet_length(c) > limit, F.lit(False))
    text, raw = over(block["text"]), over(block["raw"])
    return F.struct(
        block["kind"].alias("kind"),
        F.when(~text, block["text"]).alias("text"),
        block["mime_type"].alias("mime_type"),
        block["uri"].alias("uri"),
        F.when(~raw, block["raw"]).alias("raw"),
        F.when(text | raw, F.lit(True)).otherwise(block["truncated"]).alias("truncated"),
        F.when(raw, F.octet_length(block["raw"])).when(text, F.octet_length(block["text"])).otherwise(block["size"]).cast("long").alias("size"),
        F.when(raw, digest(block["raw"])).when(text, digest(block["text"])).otherwise(block["digest"]).alias("digest"),
    )


def truncate_json(text: Column, limit: int) -> Column:
    """Opaque JSON longer than ``limit`` bytes becomes a placeholder with its digest and size."""
    note = F.format_string('{"sha256":"%s","size":%d,"truncated":true}', digest(text), F.octet_length(text).cast("long"))
    return F.when(F.octet_length(text) > limit, note).otherwise(text)


def version_newer(a: Column, b: Column) -> Column:
    """Whether dotted version ``a`` is newer than ``b``, by the leading digits of each segment.

    Missing segments count as 0; a segment without leading digits makes the answer false.
    """
    parts = lambda v: F.transform(F.split(F.coalesce(v, F.lit("")), r"\."), lambda s: F.try_to_number(F.nullif(F.regexp_extract(s, r"^(\d{1,18})", 1), F.lit("")), F.lit("9" * 18)).cast("long"))
    x, y = parts(a), parts(b)
    both = F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)
    at = lambda v, i: F.when(i < F.size(v), F.get(v, i)).otherwise(F.lit(0))
    # 1 newer, -1 older or unreadable, 0 equal so far; the first difference decides.
    step = lambda s, i: F.when(s != 0, s).when(at(x, i).isNull() | at(y, i).isNull(), F.lit(-1)).when(at(x, i) > at(y, i), F.lit(1)).when(at(x, i) < at(y, i), F.lit(-1)).otherwise(F.lit(0))
    return F.aggregate(both, F.lit(0), step) == 1


def safe_session_id(text: Column) -> Column:
    """Whether an id is non-empty and can't be a path or a pattern."""
    return F.coalesce((text != "") & ~text.rlike(_UNSAFE_ID), F.lit(False))


def tail(text: Column, n: int) -> Column:
    """The last ``n`` bytes of a text, as text."""
    raw = text.cast("binary")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(raw, -n, n).cast("string"))


def clean_path(path: Column) -> Column:
    """A path without doubled, trailing or ``.`` segments."""
    one = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(one, r"/\.$", "/"), "(.)/$", "$1")


def foreign_cwd(cwd: Column, workdir: Column) -> Column:
    """Whether a recorded working directory is there and is not ``workdir``."""
    return F.coalesce((cwd != "") & (clean_path(cwd) != clean_path(workdir)), F.lit(False))


def overlaps_window(start_us: Column, mtime_us: Column, since_us: int | None, until_us: int | None) -> Column:
    """Whether a session's activity meets a window, both ends inclusive; an mtime may precede the start."""
    ok = F.lit(True)
    if since_us is not None:
        ok = ok & (F.greatest(start_us, mtime_us) >= since_us)
    if until_us is not None:
        ok = ok & (F.coalesce(start_us, mtime_us) <= until_us)
    return F.coalesce(ok, F.lit(False))
