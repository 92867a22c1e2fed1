"""Sessions of activity, found by a sweep over signed deltas.

Every interval of activity adds one at its start and takes one away at its end plus the gap; where the running sum
comes back to zero nobody was active for longer than the gap, and the session closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def sweep(intervals: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Merge the intervals (``key``, ``start_us``, ``end_us``, ``n``) of a key that lie at most ``gap_us`` apart.

    Result: ``key``, ``start_us``, ``end_us``, ``n`` (summed), a row per merged interval. Openings are taken before
    closings of the same instant, so a pause of exactly the gap doesn't part anything.
    """
    opening = F.struct(F.col("start_us").alias("at"), F.lit(0).alias("closing"), F.col("start_us").alias("s"), F.col("n").alias("n"))
    closing = F.struct((F.col("end_us") + gap_us).alias("at"), F.lit(1).alias("closing"), F.lit(None).cast("long").alias("s"), F.lit(0).cast("long").alias("n"))
    deltas = intervals.select(key, F.inline(F.array(opening, closing)))
    order = Window.partitionBy(key).orderBy("at", "closing")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.sum(F.lit(1) - 2 * F.col("closing")).over(upto)
    crossed = deltas.withColumn("active", active)
    # a zero closes its session; rows after it belong to the next one
    closed = F.sum(F.when(F.col("active") == 0, 1).otherwise(0)).over(upto)
    numbered = crossed.withColumn("session", closed - F.when(F.col("active") == 0, 1).otherwise(0))
    return numbered.groupBy(key, "session").agg(
        F.min("s").alias("start_us"), (F.max("at") - gap_us).alias("end_us"), F.sum("n").alias("n")
    ).select(key, "start_us", "end_us", "n")


def sessionize(df: DataFrame, key: str, at: str, gap_seconds: int = 1800) -> DataFrame:
    """Split each key's rows by ``at`` wherever more than ``gap_seconds`` pass without a row.

    First the rows of a key in one window of the gap's length become one interval: two rows of a window are closer
    than the gap, so they share a session. That step combines before the shuffle, spreads a hot key over all tasks
    and leaves at most (time span / gap) intervals of a key, however many rows it has. ``sweep`` joins the intervals.

    Result: ``key``, ``start_us BIGINT``, ``end_us BIGINT`` (first and last row in microseconds since 1970 UTC),
    ``duration_us BIGINT`` and ``n_events BIGINT``. Rows with a null key or time are left out; equal times and
    repeated rows each count as an event; an empty table has no session. Other columns are ignored.
    """
    gap_us = int(gap_seconds) * MICROS
    if gap_us <= 0:
        raise ValueError("gap_seconds must be positive")
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")
    )
    slot = F.expr(f"us div {gap_us} - cast(us % {gap_us} < 0 as int)")
    intervals = rows.groupBy("k", slot.alias("slot")).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n")
    )
    return sweep(intervals, "k", gap_us).select(
        F.col("k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        F.col("n").alias("n_events"),
    )
