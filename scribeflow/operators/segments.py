"""The sequence operators over sessions cut into segments, so that no task has to hold a whole session.

Each operator sums a segment up in a small state, combines the states of the segments before (or after) it, and
applies what comes in to the segment's rows. States have an associative merge (the last value of those that have one,
a sum, a minimum), written as a window over one row a segment; rows are only ever grouped by session and segment.
Results are those of ``sequence`` for every cut whose segments follow each other in the rows' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, SEGMENT = "session_key", "segment"
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def cut(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``segment``: ``size`` consecutive values of ``order`` each."""
    return rows.withColumn(SEGMENT, F.floor(F.col(order) / size).cast("long"))


def _segments(start: int, end: int) -> WindowSpec:
    """A session's segments, from ``start`` to ``end`` as seen from each."""
    return Window.partitionBy(KEY).orderBy(SEGMENT).rowsBetween(start, end)


def _local(order: str) -> WindowSpec:
    return Window.partitionBy(KEY, SEGMENT).orderBy(order)


def _with_incoming(rows: DataFrame, state: list[Column], incoming: list[Column]) -> DataFrame:
    """Rows with what comes in to their segment, from one ``state`` row a segment."""
    states = rows.groupBy(KEY, SEGMENT).agg(*state).select(KEY, SEGMENT, *incoming)
    return rows.join(states, [KEY, SEGMENT])


def carry_forward(rows: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """The latest non-null value up to each row."""
    last = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_last")
    rows = _with_incoming(rows, [last], [F.last("_last", ignorenulls=True).over(_segments(_FIRST, -1)).alias("_in")])
    here = F.last(column, ignorenulls=True).over(_local(order).rowsBetween(_FIRST, 0))
    return rows.withColumn(out, F.coalesce(here, "_in")).drop("_in")


def fold_islands(rows: DataFrame, ident: str, order: str, among: Column | None = None) -> DataFrame:
    """Adds ``island`` and ``opens_island``; see ``sequence.fold_islands``.

    State: the identity of the first and of the last row that counts, and how many runs open after the first.
    """
    rows = rows.withColumn("_among", F.coalesce(among, F.lit(False)) if among is not None else F.lit(True))
    by = Window.partitionBy(KEY, SEGMENT, "_among").orderBy(order)
    first = F.col("_among") & (F.row_number().over(by) == 1)
    inner = F.col("_among") & ~first & ~F.col(ident).eqNullSafe(F.lag(ident).over(by))
    rows = rows.withColumn("_first", first).withColumn("_inner", inner)
    # Identities may be null, so they are held in structs.
    held, at = F.struct(F.col(ident).alias("id")), F.when(F.col("_among"), F.col(order))
    state = [F.min_by(held, at).alias("_head"), F.max_by(held, at).alias("_tail"), F.sum(F.col("_inner").cast("int")).alias("_opens")]
    states = rows.groupBy(KEY, SEGMENT).agg(*state).withColumn("_in", F.last("_tail", ignorenulls=True).over(_segments(_FIRST, -1)))
    anew = F.col("_head").isNotNull() & (F.col("_in").isNull() | ~F.col("_in.id").eqNullSafe(F.col("_head.id")))
    states = states.withColumn("_anew", anew)
    states = states.select(KEY, SEGMENT, "_anew", F.coalesce(F.sum(F.col("_opens") + F.col("_anew").cast("int")).over(_segments(_FIRST, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(states, [KEY, SEGMENT])
    rows = rows.withColumn("opens_island", F.col("_inner") | (F.col("_first") & F.col("_anew")))
    island = F.col("_base") + F.sum(F.col("opens_island").cast("int")).over(by)
    return rows.withColumn("island", F.when(F.col("_among"), island)).drop("_among", "_first", "_inner", "_anew", "_base")


def closing_lines(rows: DataFrame, opens: Column, closes: Column, order: str) -> DataFrame:
    """Adds ``close_line`` and ``owner_close``; see ``sequence.closing_lines``.

    State: whether the last closing row opens an anchor, then the first row that ends one.
    """
    by = _local(order)
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_closes", F.coalesce(closes, F.lit(False)))
    last = F.max_by("_opens", F.when(F.col("_closes"), F.col(order))).alias("_last")
    ends = [F.last("_last", ignorenulls=True).over(_segments(_FIRST, to)).alias(name) for to, name in ((-1, "_in"), (_LAST, "_final"))]
    rows = _with_incoming(rows, [last], ends)
    here = F.last(F.when(F.col("_closes"), F.col("_opens")), ignorenulls=True).over(by.rowsBetween(_FIRST, -1))
    rows = rows.withColumn("_ends", F.col("_closes") & F.coalesce(here, "_in", F.lit(False)))
    rows = _with_incoming(rows, [F.min(F.when(F.col("_ends"), F.col(order))).alias("_end")], [F.min("_end").over(_segments(1, _LAST)).alias("_later")])
    next_end = F.coalesce(F.min(F.when(F.col("_ends"), F.col(order))).over(by.rowsBetween(1, _LAST)), "_later")
    rows = rows.withColumn("_next", next_end)
    owner = F.coalesce("_next", F.when(F.col("_final"), F.lit(2**63 - 1)))
    return rows.withColumn("owner_close", owner).withColumn("close_line", F.when(F.col("_opens"), F.col("_next"))).drop("_opens", "_closes", "_ends", "_in", "_final", "_later", "_next")


def fifo_match(rows: DataFrame, starts: Column, takes: Column, n_calls: Column, order: str) -> DataFrame:
    """Adds ``call_index`` and ``call_owner``; see ``sequence.fifo_match``.

    State: the last row that starts a queue, the calls it has, and how many rows took since, or took in all.
    """
    by = _local(order)
    rows = rows.withColumn("_starts", F.coalesce(starts, F.lit(False))).withColumn("_takes", F.coalesce(takes, F.lit(False))).withColumn("_n", n_calls)
    rows = rows.withColumn("_part", F.sum(F.col("_starts").cast("int")).over(by))
    # A starting row that takes too takes from its own queue, as in ``sequence``.
    rows = rows.withColumn("_rank", F.sum(F.col("_takes").cast("int")).over(Window.partitionBy(KEY, SEGMENT, "_part").orderBy(order)))
    started = F.when(F.col("_starts"), F.col(order))
    state = [
        F.max_by(F.struct(F.col(order).alias("owner"), F.col("_n").alias("calls")), started).alias("_queue"),
        F.max_by("_rank", F.col(order)).alias("_took"),
        F.sum(F.col("_takes").cast("long")).alias("_all"),
    ]
    states = rows.groupBy(KEY, SEGMENT).agg(*state)
    states = states.withColumn("_sum", F.sum("_all").over(_segments(_FIRST, 0)))
    # What was taken from the queue in its own segment, less all that was taken up to there.
    queue = F.when(F.col("_queue").isNotNull(), F.struct("_queue.owner", "_queue.calls", (F.col("_took") - F.col("_sum")).alias("less")))
    states = states.withColumn("_in", F.last(queue, ignorenulls=True).over(_segments(_FIRST, -1)))
    states = states.select(KEY, SEGMENT, "_in", (F.col("_sum") - F.col("_all") + F.col("_in.less")).alias("_taken"))
    rows = rows.join(states, [KEY, SEGMENT])
    part = Window.partitionBy(KEY, SEGMENT, "_part").orderBy(order)
    own = F.first(F.when(F.col("_starts"), F.struct(F.col(order).alias("owner"), F.col("_n").alias("calls"))), ignorenulls=True).over(part)
    rows = rows.withColumn("_own", own)
    inherited = F.col("_part") == 0
    rank = F.when(inherited, F.col("_rank") + F.coalesce("_taken", F.lit(0))).otherwise(F.col("_rank"))
    calls = F.when(inherited, F.col("_in.calls")).otherwise(F.col("_own.calls"))
    owner = F.when(inherited, F.col("_in.owner")).otherwise(F.col("_own.owner"))
    ok = F.col("_takes") & (rank <= F.coalesce(calls, F.lit(0)))
    rows = rows.withColumn("call_index", F.when(ok, rank - 1)).withColumn("call_owner", F.when(ok, owner))
    return rows.drop("_starts", "_takes", "_n", "_part", "_rank", "_in", "_taken", "_own")
