"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. Equal word sequences fall into one class, so that exact copies never meet as pairs.
2. Each text gets a fast similarity sketch of ``N_BANDS`` x ``BAND`` coordinates: round i < t hashes every
   shingle to one bin, round t + b puts every shingle into bin b, and a bin keeps its smallest (round,
   hash). Rounds stop once all bins are filled; after 2t rounds they must be. Two sets agree in a bin
   with probability equal to their Jaccard similarity, with concentration as if bins were independent.
3. Classes that agree in all coordinates of a band are candidates. A pair of similarity 0.75 agrees in
   none of the 50 bands of 6 with probability 6e-5.
4. Candidates are linked in two steps, both confirmed on full shingle sets. Chains: within a band's
   bucket each class is compared with the next in order, one pair for each row, which joins most groups
   up. Completion: classes still in different components are compared wherever they share a shingle of
   their prefix in order of rarity; sets of similarity 0.75 must share one, so no link is lost, and pairs
   within a component are not built. Before full sets meet, parity bitmaps of 1024 bits rule out pairs
   exactly: two sets differ in at least as many shingles as their bitmaps in bits. Components come from
   alternating large-star and small-star steps.

Defined results: null texts and texts without words have no shingles, link with nothing and stay; under
five words the whole sequence is the one shingle; repeated ids keep one row each and share a component;
rows with a null id take part, and the smallest id skips them; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .common import Scratch, lower_words, map_batches, mapped, mix, shingles, slices

N_BANDS, BAND = 50, 6
T = N_BANDS * BAND
#: Bands whose chains are compared before completion.
CHAIN_BANDS = 16
#: Ids up to this many are broadcast to pick candidates' texts; beyond it the tables are joined by shuffle.
BROADCAST_IDS = 500_000

_ROUND = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def class_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: an array of shape (sets, t)."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, np.uint64)
    full = np.iinfo(np.uint64).max
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    low = np.uint64((1 << 48) - 1)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items ^ _ROUND[i])
        if i < t:
            at = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            at = np.full(len(items), i - t, np.int64)
        # The low bits hash once more, so that a value is independent of its bin.
        np.minimum.at(out, doc * t + at, (mix(h) & low) | np.uint64(i << 48))
        if i % (1 if i < 4 else 4) == 0 or i >= t:
            left = (out.reshape(-1, t) == full).any(1)
            keep = left[doc]
            if not keep.all():
                items, doc = items[keep], doc[keep]
    return out.reshape(len(sets), t)


def _sketch_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    texts = batch.column("text").to_pylist()
    words = [lower_words(t) for t in texts]
    sets = [shingles(w) for w in words]
    some = [i for i, s in enumerate(sets) if len(s)]
    # Equal texts of a slice are sketched once.
    classes = [class_of(words[i]) for i in some]
    first: dict[bytes, int] = {}
    for i, c in zip(some, classes, strict=True):
        first.setdefault(c, i)
    order = list(first.values())
    table = sketches([sets[i] for i in order])
    bands = np.zeros((len(order), N_BANDS), np.uint64)
    for b in range(N_BANDS):
        h = np.full(len(order), b + 1, np.uint64)
        for k in range(BAND):
            h = mix(h ^ table[:, b * BAND + k])
        bands[:, b] = h
    where = {c: k for k, c in enumerate(first)}
    signed = bands.view(np.int64)
    of = dict(zip(some, classes, strict=True))
    yield {
        "doc_id": batch.column("doc_id"),
        "cls": [of.get(i) for i in range(len(texts))],
        "n_shingles": [len(s) for s in sets],
        "bands": [signed[where[of[i]]] if i in of else None for i in range(len(texts))],
    }


def parity(items: np.ndarray) -> np.ndarray:
    """1024 bits as 16 longs: whether an odd number of the items fall on each."""
    at = (mix(items ^ _ROUND[-1]) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1024) & 1).astype(np.uint8)).view(np.int64)


def _shingle_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    seen: dict[bytes, np.ndarray] = {}
    for t in batch.column("text").to_pylist():
        w = lower_words(t)
        if w:
            seen.setdefault(class_of(w), shingles(w))
    yield {"cls": list(seen), "n": [len(s) for s in seen.values()], "items": [s.view(np.int64) for s in seen.values()], "bits": [parity(s) for s in seen.values()]}


def may_link(percent: int) -> str:
    """SQL over na, nb, xa, xb: false only if sizes or bitmaps rule a similarity of percent / 100 out."""
    apart = "aggregate(zip_with(xa, xb, (x, y) -> bit_count(x ^ y)), 0, (n, k) -> n + k)"
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * (na + nb - {apart}) >= {2 * percent} * (na + nb)"


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node of each node's component, over ``edges`` (a, b).

    Alternates large-star and small-star until no edge changes; each step is a few shuffles of ids and
    is written to the scratch folder. Nodes without an edge are not in the result.
    """
    both = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    step = 0
    while True:
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        near = both.select("u", "v").union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step + 1}")
        step += 1
        # Done once each node has one edge and no root has an edge upwards: the edges are stars.
        bad = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        loose = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        done = bad.select("u").union(loose).isEmpty()
        scratch.drop(f"{name}{step - 1}")
        both = after
        if done:
            break
    return both.select(F.col("u").alias("node"), F.col("v").alias("root")).union(both.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets have a Jaccard similarity of ``percent`` / 100 at least."""
    one = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    met = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return met.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, classes_too: bool = False) -> DataFrame:
    """One row for each of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    With ``classes_too`` also cls, the row's class of equal texts, and root, the component as a class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.write(map_batches(docs, _sketch_batch, "doc_id long, cls binary, n_shingles long, bands array<long>"), "rows")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    banded = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    bucket = Window.partitionBy("bucket")
    # The order within a bucket differs from band to band, so that chains of several bands add up.
    ordered = bucket.orderBy(F.xxhash64("cls", "band"), "cls")
    shared = banded.withColumn("before", F.lag("cls").over(ordered)).withColumn("after", F.lead("cls").over(ordered)).where("before is not null or after is not null")
    shared = scratch.write(shared.select("cls", "band", "before"), "shared")
    members = scratch.write(classes.select("cls", "first_id").join(shared.select("cls").distinct(), "cls"), "members")
    if members.isEmpty():
        return _labelled(rows, classes.select("cls", F.col("cls").alias("root"), "first_id"), classes_too)
    ids = members.select(F.col("first_id").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    picked = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = map_batches(picked, _shingle_batch, "cls binary, n int, items array<long>, bits array<long>").groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n", "items", "bits")))
    sets = scratch.write(sets.join(members.select("cls"), "cls", "left_semi"), "sets")
    chains = shared.where((F.col("before").isNotNull()) & (F.col("band") < CHAIN_BANDS)).select(F.least("cls", "before").alias("a"), F.greatest("cls", "before").alias("b")).distinct()
    side = lambda k: sets.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"x{k}"))
    near = chains.join(side("a"), "a").join(side("b"), "b").where(may_link(percent)).select("a", "b")
    links = scratch.write(verified(scratch.write(near, "near"), sets, percent), "links")
    scratch.drop("near", "shared")
    root = _roots(members, components(links, scratch, "first"))
    more = scratch.write(verified(scratch.write(_completion(sets, root, scratch, percent), "late"), sets, percent), "more")
    scratch.drop("sets", "late", "heads", "numbered")
    if not more.isEmpty():
        # Components of components: only their roots are linked further.
        of = root.select("cls", "root")
        joined = more.join(of.select(F.col("cls").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("cls").alias("b"), F.col("root").alias("rb")), "b")
        upper = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch, "second")
        root = root.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("cls", F.coalesce("top", "root").alias("root"))
    heads = classes.select("cls", "first_id").join(root, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "first_id")
    return _labelled(rows, heads, classes_too)


def with_class(docs: DataFrame) -> DataFrame:
    """``docs`` as row (a struct), doc_id and cls, which is null for texts without words."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T_.StructType([packed.schema["row"], packed.schema["doc_id"], T_.StructField("cls", T_.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words = (lower_words(t) for t in piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([class_of(w) if w else None for w in words], pa.binary())], names=["row", "doc_id", "cls"])

    return mapped(packed, run, schema)


def _roots(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))


def _completion(sets: DataFrame, root: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle and fit in size."""
    # Classes and components go by numbers here, which are a third as wide as their digests.
    members = scratch.write(sets.select("cls", "n", "bits").join(root, "cls").withColumn("id", F.monotonically_increasing_id()), "numbered")
    members = members.join(members.groupBy("root").agg(F.min("id").alias("rid")), "root").select("cls", "id", "rid", "n", "bits")
    owned = scratch.write(sets.select("cls", "items").join(members, "cls").select("id", "rid", "n", F.explode("items").alias("item")), "items")
    spread = owned.groupBy("item", "rid").agg(F.count("*").alias("c")).groupBy("item").agg(F.sum("c").alias("freq"), F.count("*").alias("roots"), F.max_by("rid", F.struct("c", "rid")).alias("main"))
    # Items of one set alone are the rarest; they are counted, not ranked.
    by = Window.partitionBy("id")
    alone = F.col("n") - F.count("*").over(by)
    at = alone + F.row_number().over(by.orderBy("freq", "item"))
    # Sets of n and m items with similarity s share s / (1 + s) * (n + m) >= s * n items.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    head = owned.join(spread.where("freq > 1"), "item").withColumn("at", at).where((F.col("at") <= prefix) & (F.col("roots") > 1))
    head = scratch.write(head.select("item", "id", "main").join(members, "id"), "heads")
    scratch.drop("items")
    # An item's largest component never meets itself: only rows of the others stand on the left.
    left = head.where("rid <> main").select("item", F.col("cls").alias("a"), F.col("rid").alias("ra"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = head.select("item", F.col("cls").alias("b"), F.col("rid").alias("rb"), F.col("n").alias("nb"), F.col("bits").alias("xb"), (F.col("rid") == F.col("main")).alias("big"))
    return left.join(right, "item").where(f"ra <> rb AND (big OR a < b) AND {may_link(percent)}").select("a", "b").distinct()


def _labelled(rows: DataFrame, heads: DataFrame, classes_too: bool) -> DataFrame:
    least = heads.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = heads.select("cls", "root").join(least, "root").select("cls", "root", "component_id")
    out = rows.select("doc_id", "cls", "n_shingles").join(of, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), *(["cls", "root"] if classes_too else []))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by an exact join of all shingles; closures of links are small on small tables.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS x FROM documents UNION SELECT r.d, v.b FROM r JOIN both_ways v ON r.x = v.a),
c AS (SELECT d AS doc_id, min(x) AS component_id FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
