"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern (the set of
sources), so that the flow network has a node for each pattern and each source, whatever the number
of documents. A pattern offers its tokens once at cost 0, and again up to ``max_repeats`` times at
rising (convex) costs; sources ask for their quotas. Successive shortest paths send the flow, then a
pattern's flow is spent on whole passes over its documents and a seeded selection for the rest.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share all tokens; a target
above ``max_repeats`` times its source's tokens stops there and its excess is shared again by weight.

Defined results: a null text has size 0; a document of size 0 takes 0; a null source is a source of its
own, the last, and so are null memberships; a document of no source takes 0. Documents are rows, not ids:
null ids, repeated ids and equal rows are each their own. Which documents are taken follows from a hash of
the whole row (map columns aside), so that the same rows and seed give the same mix in any order and
layout. Other columns, whatever their names, are carried along in ``row``; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

WEIGHTS = (1, 2, 3)
#: Most membership patterns, and so rows on the driver; more are an error.
MOST_PATTERNS = 1_000_000
#: Marks of patterns up to this many are broadcast; beyond it the tables are joined by shuffle.
BROADCAST_PATTERNS = 100_000
#: Top bits of a row's hash by which sizes are first added up.
BUCKET_BITS = 14
SALTS = 1024


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size."""
    target = [0.0] * len(sizes)
    total = float(sum(sizes))
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        gone = set(over)
        free = [i for i in free if i not in gone]
    return target


def min_cost_flow(patterns: list[tuple[frozenset[int], int]], quotas: list[int], max_repeats: int) -> dict[tuple[int, int], int]:
    """Tokens to send from each pattern to each source: {(pattern, source): tokens}.

    Successive shortest paths with potentials; the cost of a pattern's r-th pass is (r - 1)^2.
    """
    n = 2 + len(patterns) + len(quotas)
    start, end = 0, n - 1
    graph: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(z)
            cost.append(v)
        return len(to) - 2

    links: dict[tuple[int, int], int] = {}
    for p, (members, size) in enumerate(patterns):
        for r in range(max_repeats):
            arc(start, 1 + p, size, r * r)
        for s in sorted(members):
            links[p, s] = arc(1 + p, 1 + len(patterns) + s, size * max_repeats, 0)
    for s, quota in enumerate(quotas):
        arc(1 + len(patterns) + s, end, quota, 0)
    height = [0] * n
    while True:
        dist: list[float] = [float("inf")] * n
        came = [-1] * n
        dist[start] = 0
        queue = [(0.0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for e in graph[a]:
                if room[e] > 0 and (x := d + cost[e] + height[a] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]], came[to[e]] = x, e
                    heapq.heappush(queue, (x, to[e]))
        if came[end] < 0:
            break
        height = [h + d if d < float("inf") else h for h, d in zip(height, dist, strict=True)]
        path, at = [], end
        while at != start:
            path.append(came[at])
            at = to[came[at] ^ 1]
        sent = min(room[e] for e in path)
        for e in path:
            room[e] -= sent
            room[e ^ 1] += sent
    return {k: room[e ^ 1] for k, e in links.items() if room[e ^ 1] > 0}


def flow_by_parts(patterns: list[tuple[frozenset[int], int]], quotas: list[int], max_repeats: int) -> dict[tuple[int, int], int]:
    """``min_cost_flow`` of each connected part of the network on its own, which is the same flow."""
    head = list(range(len(quotas)))

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for members, _ in patterns:
        first = next(iter(members), None)
        for x in members:
            head[find(x)] = find(first)
    parts: dict[int, list[int]] = {}
    for p, (members, size) in enumerate(patterns):
        if members and size:
            parts.setdefault(find(next(iter(members))), []).append(p)
    out: dict[tuple[int, int], int] = {}
    for rows in parts.values():
        names = sorted({x for p in rows for x in patterns[p][0]})
        place = {x: i for i, x in enumerate(names)}
        flow = min_cost_flow([(frozenset(place[x] for x in patterns[p][0]), patterns[p][1]) for p in rows], [quotas[x] for x in names], max_repeats)
        out |= {(rows[p], names[x]): v for (p, x), v in flow.items()}
    return out


def mix_sources(docs: DataFrame, sources: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: int = 11) -> tuple[DataFrame, dict]:
    """(row, pattern, size, pattern_size, repeats, taken) of each of ``docs``, and the sources' figures.

    ``sources``: array<string> of a document's sources; ``size``: its tokens. The driver holds a few rows for
    each pattern, never one for each document. The rest of a pattern beyond whole passes goes to its
    documents in order of their hashes: all below an edge, and as many copies of the row at the edge as come
    nearest. One more document changes sides where that comes nearer still.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # A pattern is the sorted set of sources written as JSON, which keeps null and any character apart.
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    base = docs.select(F.struct("*").alias("row"), pattern.alias("pattern"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), *told).alias("h"))
    # Equal rows are one class, counted before the shuffle.
    classes = scratch.write(base.groupBy("pattern", "h", "size").agg(F.count("*").alias("n")), "classes")
    bucket = F.shiftright("h", 64 - BUCKET_BITS)
    sums = scratch.write(classes.groupBy("pattern", bucket.alias("b")).agg(F.sum(F.col("size") * F.col("n")).alias("s")), "sums")
    patterns = [(r["pattern"], json.loads(r["pattern"]), int(r["s"])) for r in sums.groupBy("pattern").agg(F.sum("s").alias("s")).limit(MOST_PATTERNS + 1).collect()]
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    patterns.sort(key=lambda x: x[0])
    held_by: dict[str | None, int] = {}
    for _, m, s in patterns:
        for x in m:
            held_by[x] = held_by.get(x, 0) + s
    names = sorted(held_by, key=lambda x: (x is None, x or ""))
    place = {x: i for i, x in enumerate(names)}
    held = [held_by[x] for x in names]
    total = sum(s for _, m, s in patterns if m)
    share = [float(weights[i % len(weights)]) for i in range(len(names))]
    targets = _scaled(water_fill(held, share, max_repeats), total)
    flow = flow_by_parts([(frozenset(place[x] for x in m), s) for _, m, s in patterns], [int(round(t)) for t in targets], max_repeats)
    sent = [0] * len(patterns)
    for (p, _), v in flow.items():
        sent[p] += v
    plan = {}
    for p, (name, _, s) in enumerate(patterns):
        passes = min(max_repeats, sent[p] // s) if s else 0
        plan[name] = {"passes": passes, "rest": sent[p] - passes * s if passes < max_repeats else 0, "size": s}
    broad = F.broadcast if len(plan) <= BROADCAST_PATTERNS else lambda df: df
    edges = {r["pattern"]: r for r in _edges(classes, sums, bucket, spark.createDataFrame([(k, v["rest"]) for k, v in plan.items() if v["rest"]], "pattern string, rest long"), broad).collect()}
    for e in edges.values():
        k = min(e["n"], (2 * e["need"] + e["size"]) // (2 * e["size"]))  # copies nearest to what is needed
        plan[e["pattern"]] |= {"edge": e["h"], "edge_size": e["size"], "edge_n": e["n"], "edge_take": k, "gap": e["need"] - k * e["size"]}
    gaps = spark.createDataFrame([(k, v["edge"], v["edge_size"], v["gap"]) for k, v in plan.items() if v.get("gap")], "pattern string, edge long, edge_size long, gap long")
    for f in _flips(classes, gaps, broad).collect():
        plan[f["pattern"]] |= {"flip": f["h"], "flip_size": f["size"], "flip_n": f["n"], "flip_by": f["by"]}
    fields = ("passes", "edge", "edge_size", "edge_n", "edge_take", "flip", "flip_size", "flip_n", "flip_by", "size")
    marks = spark.createDataFrame([(k, *(v.get(f) for f in fields)) for k, v in plan.items()], "pattern string, passes int, edge long, edge_size long, edge_n long, edge_take long, flip long, flip_size long, flip_n long, flip_by int, pattern_size long")
    out = base.join(broad(marks), "pattern", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    at_edge = yes((F.col("h") == F.col("edge")) & (F.col("size") == F.col("edge_size")))
    flips = yes((F.col("h") == F.col("flip")) & (F.col("size") == F.col("flip_size")))
    below = yes((F.col("h") < F.col("edge")) | (F.col("h") == F.col("edge")) & (F.col("size") < F.col("edge_size")))
    some = any(v.get("flip_n", 0) > 1 or 0 < v.get("edge_take", 0) < v.get("edge_n", 0) for v in plan.values())
    out = _ranked(out, (at_edge & (F.col("edge_n") > 1)) | (flips & (F.col("flip_n") > 1))) if some else out.withColumn("rank", F.lit(1).cast("long"))
    once = F.when(at_edge, (F.col("rank") <= F.col("edge_take")).cast("int")).otherwise(below.cast("int")) + F.when(flips & (F.col("rank") == 1), F.col("flip_by")).otherwise(0)
    out = out.withColumn("repeats", (F.coalesce("passes", F.lit(0)) + once).cast("int"))
    out = out.select("row", "pattern", "size", "pattern_size", "repeats", F.coalesce(F.col("size") * F.col("repeats"), F.lit(0)).cast("long").alias("taken"))
    return out, {"names": names, "held": held, "targets": targets}


def _edges(classes: DataFrame, sums: DataFrame, bucket: Column, rests: DataFrame, broad) -> DataFrame:
    """(pattern, h, size, n, need): the class at which a pattern's rest runs out, and what it is to give.

    Sums by bucket find the bucket, then the classes of that bucket alone are put in order.
    """
    upto = F.sum("s").over(Window.partitionBy("pattern").orderBy("b"))
    cut = sums.join(broad(rests), "pattern").withColumn("upto", upto).where("upto >= rest and upto - s < rest").select("pattern", "b", (F.col("rest") - F.col("upto") + F.col("s")).alias("need"))
    inside = classes.where("size > 0").withColumn("b", bucket).join(broad(cut), ["pattern", "b"])
    fine = Window.partitionBy("pattern").orderBy("h", "size")
    inside = inside.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(fine)).withColumn("before", F.col("upto") - F.col("size") * F.col("n"))
    return inside.where("before < need and upto >= need").select("pattern", "h", "size", "n", (F.col("need") - F.col("before")).alias("need"))


def _flips(classes: DataFrame, gaps: DataFrame, broad) -> DataFrame:
    """(pattern, h, size, n, by): the class of which one copy changes sides, its size being nearest to the gap."""
    near = classes.where("size > 0").join(broad(gaps), "pattern")
    off = F.abs(F.abs("gap") - F.col("size"))
    below = (F.col("h") < F.col("edge")) | (F.col("h") == F.col("edge")) & (F.col("size") < F.col("edge_size"))
    near = near.where(~((F.col("h") == F.col("edge")) & (F.col("size") == F.col("edge_size")))).where(((F.col("gap") > 0) & ~below) | ((F.col("gap") < 0) & below)).where(off < F.abs("gap"))
    found = near.groupBy("pattern").agg(F.min_by(F.struct("h", "size", "n", F.signum("gap").cast("int").alias("by")), F.struct(off, F.col("h"), F.col("size"))).alias("f"))
    return found.select("pattern", "f.*")


def _ranked(out: DataFrame, shared: Column) -> DataFrame:
    """Adds rank, from 1: the place of a row among its copies where ``shared``, else 1.

    Copies, of which one class may have very many, are numbered within salts, and salts by their counts.
    """
    out = out.withColumn("shared", shared)
    some = out.where("shared").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)))
    key = ("pattern", "h", "size")
    counts = some.groupBy(*key, "salt").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*key).orderBy("salt")) - F.col("c")).drop("c")
    own = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("salt"))
    some = some.withColumn("own", own).join(before, [*key, "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before")
    return some.unionByName(out.where("not shared").withColumn("rank", F.lit(1).cast("long")))


def _scaled(targets: list[float], total: int) -> list[float]:
    """Overlapping sources count their common tokens twice; targets share each token once."""
    most = sum(targets)
    return [t * total / most for t in targets] if most > total > 0 else targets


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size"))
    mixed, known = mix_sources(Scratch(spark, "sizes").write(docs, "docs"), F.array("source"), F.col("size"))
    rows = list(zip(known["names"], known["held"], known["targets"], strict=True))
    table = spark.createDataFrame(rows, "s string, source_size long, target double")
    table = F.broadcast(table) if len(rows) <= BROADCAST_PATTERNS else table
    return mixed.join(table, F.col("row.source").eqNullSafe(F.col("s"))).select("row.doc_id", "size", "source_size", "target", "taken", "repeats")
