"""Ranks and running sums within groups of any size, without a task per group.

A group's rows are dealt into buckets in the order of a hash, as many as its size asks for. The sums of the buckets are
accumulated first; within a bucket an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about, and the most buckets a group is dealt into.
BUCKET_ROWS, MOST_BUCKETS = 100_000, 65_536


def bucket_bits(size: Column, bucket_rows: int = BUCKET_ROWS) -> Column:
    """The bits of a group's bucket numbers: as many as give buckets of at most ``bucket_rows`` rows of its ``size``, up to MOST_BUCKETS."""
    bits = F.ceil(F.log2(F.greatest(size.cast("double"), F.lit(1.0)) / F.lit(float(bucket_rows))))
    return F.least(F.greatest(bits, F.lit(0)), F.lit(MOST_BUCKETS.bit_length() - 1)).cast("int")


def running_total(
    df: DataFrame, group: list[str], hashed: str, ties: list[str], amount: str, out: str, bucket_rows: int = BUCKET_ROWS, few: bool = True
) -> DataFrame:
    """``df`` with ``out``: the sum of ``amount`` over the rows of its group that precede it.

    Rows are ordered by the unsigned hash ``hashed``, then ``ties``, which together must tell rows apart. A bucket is a
    range of the hash, and a group has as many of them as its number of rows asks for; rows learn that number by a join
    with a row per group. ``df`` is read three times; pass a materialized one. Where groups are ``few`` (sizes, patterns)
    their counts are broadcast.
    """
    if group:
        counts = df.groupBy(*group).agg(bucket_bits(F.count(F.lit(1)), bucket_rows).alias("bits__"))
        told = df.join(F.broadcast(counts) if few else counts, group)
    else:  # one number
        told = df.withColumn("bits__", bucket_bits(F.lit(df.count()), bucket_rows))
    # the upper bits; a shift by 64 would be one by 0
    bucket = F.when(F.col("bits__") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(`{hashed}`, 64 - greatest(bits__, 1))"))
    dealt = told.withColumn("bucket__", bucket).drop("bits__")
    sums = dealt.groupBy(*group, "bucket__").agg(F.sum(amount).alias("sum__"))
    before = Window.partitionBy(*group).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "bucket__", F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("offset__"))
    within = Window.partitionBy(*group, "bucket__").orderBy(hashed, *ties).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(within), F.lit(0))
    return (
        dealt.withColumn("inside__", inside)
        .join(offsets, [*group, "bucket__"])
        .withColumn(out, (F.col("offset__") + F.col("inside__")).cast("long"))
        .drop("bucket__", "inside__", "offset__")
    )
