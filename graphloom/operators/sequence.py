"""Consecutive numbers over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import materialize


def number_rows(df: DataFrame, order: list[str], name: str = "seq", first: int = 1) -> DataFrame:
    """``df`` with ``name``: the place of each row in ``order``, from ``first``.

    The rows are range partitioned and sorted, written once (so that both later passes see the same partitions), and
    each partition's numbers are shifted by the rows before it; of the partitions' sizes there is one row each.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition * 2^33 + place in it
    held = materialize(sorted_rows.withColumn("place__", place), "numbered")
    part = F.shiftright("place__", 33)
    sizes = held.groupBy(part.alias("part__")).agg(F.count(F.lit(1)).alias("size__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part__", F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("offset__"))
    within = F.col("place__").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        held.withColumn("part__", part)
        .join(F.broadcast(offsets), "part__")
        .withColumn(name, (F.col("offset__") + within + first).cast("long"))
        .drop("part__", "place__", "offset__")
    )
