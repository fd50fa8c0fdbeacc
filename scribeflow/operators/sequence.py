"""Stateful sequence operators in closed window form; each works within one session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "session_key"


def fold_islands(rows: DataFrame, ident: str, order: str, among: Column | None = None) -> DataFrame:
    """Adds ``island``: runs of rows with the same ``ident``, counted from 1, and ``opens_island``.

    ``among``: the rows that count; the others neither extend nor end a run and have no island.
    """
    rows = rows.withColumn("_among", F.coalesce(among, F.lit(False)) if among is not None else F.lit(True))
    by = Window.partitionBy(KEY, "_among").orderBy(order)
    changed = (~F.col(ident).eqNullSafe(F.lag(ident).over(by))) | (F.row_number().over(by) == 1)
    rows = rows.withColumn("opens_island", F.col("_among") & changed)
    return rows.withColumn("island", F.when(F.col("_among"), F.sum(F.col("opens_island").cast("int")).over(by))).drop("_among")


def resumed_folds(islands: DataFrame, ident: str, order: str) -> DataFrame:
    """The first row of each island whose ``ident`` had an island before: always an error."""
    starts = islands.groupBy(KEY, ident, "island").agg(F.min(order).alias(order))
    again = Window.partitionBy(KEY, ident).orderBy("island")
    return starts.withColumn("_n", F.row_number().over(again)).where("_n > 1").drop("_n")


def closing_lines(rows: DataFrame, opens: Column, closes: Column, order: str) -> DataFrame:
    """Adds ``close_line`` to rows that open an anchor: the next closing row's ``order``, NULL at the end.

    Adds ``owner_close`` too: for every row the close of the first anchor that closes after it, or
    the largest long for one closed by the end, or NULL for none.
    """
    by = Window.partitionBy(KEY).orderBy(order)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_closes", F.coalesce(closes, F.lit(False)))
    # A row closes an anchor if the closing row before it opened one.
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_closes"), F.col("_opens")), ignorenulls=True).over(before)
    rows = rows.withColumn("_ends", F.col("_closes") & F.coalesce(last, F.lit(False)))
    next_end = F.min(F.when(F.col("_ends"), F.col(order))).over(after)
    # The anchor still open at the end is the last closing row, if that opens one.
    final = F.last(F.when(F.col("_closes"), F.col("_opens")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    owner = F.coalesce(next_end, F.when(final, F.lit(2**63 - 1)))
    return rows.withColumn("owner_close", owner).withColumn("close_line", F.when(F.col("_opens"), next_end)).drop("_closes", "_ends")


def fifo_match(rows: DataFrame, starts: Column, takes: Column, n_calls: Column, order: str) -> DataFrame:
    """Adds ``call_index`` (0-based) and ``call_owner`` to rows that take the oldest pending call.

    A starting row drops what is pending and enqueues ``n_calls`` calls; both are NULL without one left.
    """
    by = Window.partitionBy(KEY).orderBy(order)
    rows = rows.withColumn("_starts", F.coalesce(starts, F.lit(False))).withColumn("_takes", F.coalesce(takes, F.lit(False)))
    rows = rows.withColumn("_seg", F.sum(F.col("_starts").cast("int")).over(by))
    seg = Window.partitionBy(KEY, "_seg").orderBy(order)
    rows = rows.withColumn("_rank", F.sum(F.col("_takes").cast("int")).over(seg))
    rows = rows.withColumn("_calls", F.first(F.when(F.col("_starts"), n_calls), ignorenulls=True).over(seg)).withColumn("_owner", F.first(F.when(F.col("_starts"), F.col(order)), ignorenulls=True).over(seg))
    ok = F.col("_takes") & (F.col("_rank") <= F.coalesce("_calls", F.lit(0)))
    return rows.withColumn("call_index", F.when(ok, F.col("_rank") - 1)).withColumn("call_owner", F.when(ok, F.col("_owner"))).drop("_starts", "_takes", "_seg", "_rank", "_calls", "_owner")


def carry_forward(rows: DataFrame, column: str, order: str, out: str) -> DataFrame:
    """The latest non-null value up to each row."""
    by = Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(by))


def step_order(rows: DataFrame, step: str, line: str) -> DataFrame:
    """``step_ord`` from 0 by step, rows without one last, ties in line order."""
    by = Window.partitionBy(KEY).orderBy(F.col(step).asc_nulls_last(), line)
    return rows.withColumn("step_ord", (F.row_number().over(by) - 1).cast("long"))
