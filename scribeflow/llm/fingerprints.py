"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long lines cut again where the bytes before a space hash to 0, so that
an edit moves cuts near it only; equal paragraphs count by occurrence. Each paragraph's 64-bit
digest goes into ``HASHES`` cells of a table: a cell holds how many digests it got, their XOR and the XOR of
their check hashes. Tables have two cells a paragraph or more, in thirds of a power of two, so that the
halves of a large one's thirds add up to the smaller one. Subtracting two tables, the larger folded to the other's size, leaves the
digests that differ; peeling takes them out one by one from cells that hold a single one. Where peeling stops early, both tables are
built larger and the difference is taken again, until it succeeds. Likeness is shared digests over all.

A fingerprint is the number of paragraphs, in eight hexadecimal digits, and the table in base 64, all exact. It grows with
the text (some 55 characters a paragraph on average), so that the fingerprints of a text and of a version of it with
a third replaced tell their likeness by themselves (``near``); those of texts that share nothing mostly don't.

The next document by descending id is found without a global sort in one task: documents are dealt to
ranges of the id, and the first of each range is also sent to the range before it.

Defined results: null texts count as empty; the empty text has no paragraph, and two empty texts have
likeness 1; rows with the same id follow each other by a hash of their text (the upper half, then the
lower), then by text; null ids come last, in that order too; a table of one row has itself as its next
document; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import mapped, mix

HASHES = 3
#: Cells of a third of the smallest table.
LEAST_THIRD = 16
#: Bytes of text for each range of ids, and most ranges.
RANGE_BYTES, MOST_RANGES = 64_000_000, 65_536
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SALT = np.uint64(0x5851F42D4C957F2D)
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))


def paragraphs(raw: bytes) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs, one for each occurrence, in order."""
    if not raw:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_SPACE[a])
    at = at[at >= 5]
    h = np.zeros(len(at), np.uint32)
    for k in range(1, 6):
        h = (h ^ a[at - k]) * np.uint32(0x01000193)
    cut = at[(((h * np.uint32(2654435761)) >> np.uint32(29)) == 0) | (a[at] == 10)]
    ends = [*(cut + 1).tolist(), len(raw)]
    out, turns, start, seen = [], [], 0, {}
    for end in ends:
        piece = raw[start:end].strip()
        start = end
        if piece:
            n = seen.get(piece, 0)
            seen[piece] = n + 1
            out.append(xxhash.xxh3_64_intdigest(piece))
            turns.append(n)
    # Seeds of the hash itself make short pieces collide; two equal digests could never be peeled.
    return np.unique(mix(np.array(out, np.uint64) ^ mix(np.array(turns, np.uint64))))


class Tables:
    """Tables of several owners, one after the other: counts, XOR of digests, XOR of check hashes by cell."""

    def __init__(self, third: np.ndarray) -> None:
        self.third = np.asarray(third, np.int64)
        self.start = np.concatenate(([0], np.cumsum(HASHES * self.third)))
        n = int(self.start[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def __len__(self) -> int:
        return len(self.third)

    def cells(self, digests: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """The cell of each digest in each third of its owner's table."""
        third, start = self.third[owner], self.start[owner]
        for k in range(HASHES):
            yield start + k * third + (mix(digests + _SEEDS[k]).astype(np.int64) & (third - 1))

    def add(self, digests: np.ndarray, owner: np.ndarray, times: np.ndarray | int = 1) -> list[np.ndarray]:
        """Puts digests in; the cells that change."""
        check = mix(digests ^ _SALT)
        touched = list(self.cells(digests, owner))
        for at in touched:
            np.add.at(self.count, at, times)
            np.bitwise_xor.at(self.keys, at, digests)
            np.bitwise_xor.at(self.checks, at, check)
        return touched

    def put(self, other: Tables, pick: np.ndarray, sign: int) -> None:
        """Adds the tables ``pick`` of others, each folded to the size of the one here that it is added to."""
        size = HASHES * other.third[pick]
        owner = np.repeat(np.arange(len(pick)), size)
        cell = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        source = np.repeat(other.start[pick], size) + cell
        wide, third = other.third[pick][owner], self.third[owner]
        at = self.start[owner] + cell // wide * third + (cell % wide & (third - 1))
        np.add.at(self.count, at, sign * other.count[source])
        np.bitwise_xor.at(self.keys, at, other.keys[source])
        np.bitwise_xor.at(self.checks, at, other.checks[source])


def third_for(paragraphs: np.ndarray | int) -> np.ndarray:
    """Cells of a third of the table for so many paragraphs: a power of two, of two thirds of them or more."""
    need = np.maximum(LEAST_THIRD, np.asarray(paragraphs, np.float64) / 1.5)
    return (1 << np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)


def tables(sets: list[np.ndarray], third: np.ndarray | None = None) -> Tables:
    """A table for each set, of the size its number of paragraphs asks for or of thirds as given."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = Tables(third_for(sizes) if third is None else third)
    out.add(np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes))
    return out


def peel(left: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, digest, sign of each recovered difference, whether each owner's table came out empty).

    All owners are peeled together, a layer of single cells a round; the tables are used up.
    """
    owner_of = np.repeat(np.arange(len(left)), HASHES * left.third)
    owners, digests, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    look = np.flatnonzero(np.abs(left.count) == 1)
    while len(look):
        pure = look[(np.abs(left.count[look]) == 1) & (mix(left.keys[look] ^ _SALT) == left.checks[look])]
        if not len(pure):
            break
        # A digest may be alone in several of its cells; it is taken out once.
        order = np.lexsort((left.keys[pure], owner_of[pure]))
        pure = pure[order]
        first = np.ones(len(pure), bool)
        first[1:] = (left.keys[pure[1:]] != left.keys[pure[:-1]]) | (owner_of[pure[1:]] != owner_of[pure[:-1]])
        pure = pure[first]
        owner, d, s = owner_of[pure], left.keys[pure].copy(), left.count[pure].copy()
        owners.append(owner)
        digests.append(d)
        signs.append(s)
        look = np.unique(np.concatenate(left.add(d, owner, -s)))
    full = (left.count != 0) | (left.keys != 0) | (left.checks != 0)
    empty = ~np.logical_or.reduceat(full, left.start[:-1]) if len(left) else np.zeros(0, bool)
    return np.concatenate(owners), np.concatenate(digests), np.concatenate(signs), empty


def subtracted(left: Tables, one: np.ndarray, right: Tables, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of tables how many digests differ, and whether peeling recovered them all."""
    both = Tables(np.minimum(left.third[one], right.third[two]))
    both.put(left, one, 1)
    both.put(right, two, -1)
    owner, _, _, empty = peel(both)
    return np.bincount(owner, minlength=len(empty)), empty


def differences(left: list[np.ndarray], right: list[np.ndarray], first: tuple[Tables, np.ndarray, Tables, np.ndarray] | None = None) -> np.ndarray:
    """How many digests differ between the sets of each pair, recovered by subtracting and peeling.

    ``first``: the sets' tables, and which of them are each pair's, where they are there already.
    """
    n = len(left)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    if first is None:
        first = tables(left), np.arange(n), tables(right), np.arange(n)
    found, empty = subtracted(*first)
    out[empty] = found[empty]
    todo = np.flatnonzero(~empty)
    third = 2 * np.minimum(first[0].third[first[1]], first[2].third[first[3]])
    # Tables much too small for even the difference in size can't be peeled, so they are skipped.
    gap = np.array([abs(len(x) - len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    while len(todo):
        third[todo] = np.maximum(third[todo], third_for(gap[todo] / 2))
        size = np.cumsum(HASHES * third[todo])
        failed = []
        for part in np.split(todo, np.flatnonzero(np.diff(size // 300_000)) + 1):
            pick = np.arange(len(part))
            found, empty = subtracted(tables([left[i] for i in part], third[part]), pick, tables([right[i] for i in part], third[part]), pick)
            out[part[empty]] = found[empty]
            failed.append(part[~empty])
        todo = np.concatenate(failed)
        third[todo] *= 2
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray], first: tuple[Tables, np.ndarray, Tables, np.ndarray] | None = None) -> np.ndarray:
    """Shared digests over all digests of each pair; 1 where both have none."""
    both = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
    d = differences(left, right, first)
    return np.where(both == 0, 1.0, (both - d) / np.maximum(both + d, 1))


_CELL = np.dtype([("c", ">u4"), ("k", ">u8"), ("h", ">u8")])


def fingerprints(table: Tables, sizes: list[int]) -> list[str]:
    """Tables as text: paragraphs, then count, key and check of every cell, all exact."""
    cells = np.zeros(len(table.count), _CELL)
    cells["c"], cells["k"], cells["h"] = table.count, table.keys, table.checks
    raw, at = cells.tobytes(), (table.start * _CELL.itemsize).tolist()
    return [f"{n:08x}" + base64.b64encode(raw[a:b]).decode() for n, a, b in zip(sizes, at[:-1], at[1:], strict=True)]


def read_fingerprint(text: str) -> tuple[int, Tables]:
    """How many paragraphs a fingerprint has, and its table."""
    cells = np.frombuffer(base64.b64decode(text[8:]), _CELL)
    out = Tables(np.array([len(cells) // HASHES]))
    out.count, out.keys, out.checks = cells["c"].astype(np.int64), cells["k"].astype(np.uint64), cells["h"].astype(np.uint64)
    return int(text[:8], 16), out


def near(left: str, right: str) -> float | None:
    """Likeness of two texts from their fingerprints alone; None where the texts differ in too much for them."""
    (n, one), (m, two) = read_fingerprint(left), read_fingerprint(right)
    found, empty = subtracted(one, np.zeros(1, np.int64), two, np.zeros(1, np.int64))
    return None if not empty[0] else 1.0 if not n + m else float((n + m - found[0]) / (n + m + found[0]))


def edited(text: str, follow: str) -> str:
    """The last third of a text replaced by as much of the next document's start."""
    k = len(text) // 3
    return text[: len(text) - k] + follow[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str], follow: str) -> pa.RecordBatch:
    """Rows for documents in order, the last of which is followed by the text ``follow``."""
    raw = lambda t: t.encode("utf-8", "surrogatepass")
    after = [*texts[1:], follow]
    changed = [raw(edited(t, f)) for t, f in zip(texts, after, strict=True)]
    own = [paragraphs(raw(t)) for t in [*texts, follow]]
    other = [paragraphs(c) for c in changed]
    mine, its = tables(own), tables(other)
    at = np.arange(len(texts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
            pa.array(fingerprints(mine, [len(x) for x in own])[:-1]),
            pa.array(fingerprints(its, [len(x) for x in other])),
            pa.array(likeness(own[:-1], other, (mine, at, its, at))),
            pa.array(likeness(own[:-1], own[1:], (mine, at, mine, at + 1))),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and order; a range ends with the row borrowed from the next one."""
    ids: list = []
    texts: list[str] = []
    part, size = None, 0
    for batch in batches:
        columns = (batch.column(k) for k in (batch.schema.names.index(n) for n in ("part", "doc_id", "text", "borrowed")))
        for p, d, t, borrowed in zip(*columns, strict=True):
            p, d, t, borrowed = p.as_py(), d.as_py(), t.as_py() or "", borrowed.as_py()
            if p != part:
                part, ids, texts, size = p, [], [], 0
            if borrowed:
                if ids:
                    yield _compare(ids, texts, t)
                ids, texts, size = [], [], 0
                continue
            if size > 1_000_000 or len(ids) >= 250:
                yield _compare(ids, texts, t)
                ids, texts, size = [], [], 0
            ids.append(d)
            texts.append(t)
            size += len(t)


def _count_above(points: list[int], value: Column) -> Column:
    """How many of the falling ``points`` are above ``value``, by halving."""
    if not points:
        return F.lit(0)
    held = F.lit(np.array(points, np.int64).tolist())
    steps = F.lit([1 << k for k in range(len(points).bit_length() - 1, -1, -1)])
    more = lambda n, k: (n + k <= len(points)) & (F.get(held, n + k - 1) > value)
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(more(n, k), n + k).otherwise(n))


def with_next(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(part, tie, doc_id, text, borrowed): ranges of descending ids, each ending with its follower; how many.

    Split points are quantiles of the id column alone. An id that several of them fall on is split further by
    the hash of its texts, and so are null ids, which come last. The driver gets the split points and each
    range's first place.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))))
    known = docs.agg(F.count("doc_id").alias("ids"), F.count("*").alias("rows")).first()
    for_null = min(parts, -(-(known["rows"] - known["ids"]) * parts // max(1, known["rows"])))
    spread = docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    often = Counter(int(c) for c in spread)
    # Ranges in falling order: (first id of the range, its parts by hash); range 0 has the largest ids.
    cuts = sorted(often, reverse=True)
    heavy = {c: often[c] for c in cuts if often[c] > 1}
    # Above cut i come i ranges and what the heavy ids among the cuts before it add.
    own = F.col("doc_id")
    start = _count_above(cuts, own)
    points = [c for c in cuts for _ in range(often[c] - 1)]
    part = start + _count_above(points, own)
    share = lambda n: F.floor(F.shiftrightunsigned("tie", 32) * n / F.lit(1 << 32)).cast("int")
    if heavy:
        ids, sizes = list(heavy), list(heavy.values())
        at = F.array_position(F.lit(ids), own)
        part = part + F.coalesce(F.when(at > 0, share(F.get(F.lit(sizes), (at - 1).cast("int")))), F.lit(0))
    last = len(spread) + 1
    part = F.when(own.isNull(), F.lit(last) + share(F.lit(max(1, for_null)))).otherwise(part).cast("int")
    placed = docs.withColumn("part", part)
    n = last + max(1, for_null)
    order = F.struct(F.bitwise_not(own), F.shiftrightunsigned("tie", 32), F.shiftleft("tie", 32))
    tops = placed.groupBy("part").agg(F.min(order).alias("top")).orderBy("part").collect()
    if not tops:
        return placed.withColumn("borrowed", F.lit(False)), n
    before = {r["part"]: tops[i - 1]["part"] for i, r in enumerate(tops)}
    heads = spark.createDataFrame([(r["part"], tuple(r["top"]), before[r["part"]]) for r in tops], StructType([StructField("part", IntegerType()), StructField("top", placed.select(order.alias("o")).schema["o"].dataType), StructField("to", IntegerType())]))
    # A head is one document, the first by text among those of the first place; heads are one a range.
    heads = placed.join(F.broadcast(heads), "part").where(order.eqNullSafe(F.col("top")))
    heads = heads.groupBy("part", "to").agg(F.min("doc_id").alias("doc_id"), F.min("tie").alias("tie"), F.min(F.struct(F.col("text").isNotNull().alias("some"), "text")).alias("t"))
    heads = heads.select("doc_id", F.col("t.text").alias("text"), "tie", F.col("to").alias("part"), F.lit(True).alias("borrowed"))
    return placed.withColumn("borrowed", F.lit(False)).unionByName(heads), n


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited version, and their likeness; see the module."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = max(8, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, n = with_next(docs, min(MOST_RANGES, max(least, size // RANGE_BYTES)))
    rows = rows.repartitionById(n, F.col("part"))  # range i goes to task i
    rows = rows.sortWithinPartitions("part", "borrowed", F.col("doc_id").desc_nulls_last(), F.shiftrightunsigned("tie", 32), F.shiftleft("tie", 32), F.col("text").asc_nulls_first())
    return mapped(rows, _walk, _SCHEMA)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
