"""Keys that hold a large share of all rows: finding them and working around them.

A *heavy* key is a non-null value in at least ``share`` of all rows, so there are never more than ``1 / share`` of
them; this is the proven bound under which they are broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize

#: Items the frequency sketch keeps; its error is below 4 / SKETCH_ITEMS of all rows.
SKETCH_ITEMS = 16_384


def heavy_candidates(df: DataFrame, key: str, share: float, sketch_items: int = SKETCH_ITEMS) -> DataFrame:
    """A superset (column ``key``) of the heavy keys, from a mergeable frequent-items sketch built in one pass.

    The sketch's counts are never too low and too high by less than ``4 / sketch_items`` of the rows, so with
    ``share`` well above that error only keys near or above ``share`` can outrank a heavy one. Twice ``1 / share``
    entries are taken, at most half of which can reach ``share``. Empty input gives an empty result.
    """
    if not 8 / sketch_items <= share <= 1:
        raise ValueError(f"share must lie in [{8 / sketch_items:g}, 1] for a sketch of {sketch_items} items")
    take = min(2 * math.ceil(1 / share) + 8, sketch_items)
    top = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {take}, {sketch_items})").alias("top"))
    return top.select(F.explode("top").alias("entry")).select(F.col("entry.item").alias(key))


def heavy_keys(df: DataFrame, key: str, share: float, sketch_items: int = SKETCH_ITEMS) -> DataFrame:
    """Exactly the non-null values of ``key`` in at least ``share`` of all rows of ``df``, with their count.

    Columns ``key``, ``rows BIGINT``, ``total BIGINT``. The sketch proposes candidates, one pass counts only those
    (they are broadcast: at most ``2 / share + 8``). Rows with a null key count in ``total``. An empty table has no
    heavy key.
    """
    rows = df.select(F.col(key).alias("k"))
    found = heavy_candidates(rows, "k", share, sketch_items).select(F.col("k").alias("c"))
    counted = (
        rows.join(F.broadcast(found), F.col("k") == F.col("c"), "left")
        .groupBy("c")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # one row per candidate and one (c null) for all others: bounded, so the total may be summed in one window
    total = F.expr("sum(rows) over ()")
    return (
        counted.withColumn("total", total)
        .where(F.col("c").isNotNull() & (F.col("rows").cast("double") >= F.lit(share) * F.col("total")))
        .select(F.col("c").alias(key), "rows", "total")
    )


def split_by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key is in the small table ``keys``, and the others (null keys among them).

    ``keys`` must have a proven size bound; it is broadcast, ``df`` is not shuffled.
    """
    small = F.broadcast(keys.select(*on).distinct())
    return df.join(small, on, "left_semi"), df.join(small, on, "left_anti")


def exact_sum(value: Column) -> Column:
    """A sum that doesn't depend on the order of rows: values are rounded to 6 decimals and added as decimals.

    Null, NaN and infinite values, and those of 1e20 and more in size, which no decimal of this scale holds, are
    left out.
    """
    v = value.cast("double")
    fit = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(1e20))
    return F.sum(F.when(fit, F.round(v.cast("decimal(27,6)"), 6)))


def left_out(value: Column) -> Column:
    """The number of infinite values and of those of 1e20 and more in size, which ``exact_sum`` leaves out."""
    v = value.cast("double")
    return F.count(F.when(~F.isnan(v) & (F.abs(v) >= F.lit(1e20)), 1))


def per_key_stats(
    df: DataFrame, key: str, member: str, value: str, share: float = 0.001, salts: int = 64, tell_left_out: bool = False
) -> DataFrame:
    """Rows, distinct members and total value of every non-null key, without a task per heavy key.

    Heavy keys (``heavy_keys`` at ``share``) come out by a broadcast join: their rows stay where they are, are
    aggregated per (key, salt of the member) and then per key; a member has one salt, so distinct counts add up.
    The others go by an ordinary shuffle of pre-aggregated (key, member) groups. The parts are disjoint and united.

    Result: ``key``, ``rows BIGINT``, ``members BIGINT`` (distinct, nulls not counted), ``total`` DOUBLE, the sum of
    the usable values as ``exact_sum`` takes them (null if there is none). Rows with a null key are left out,
    repeated rows count as often as they occur; an empty table gives an empty result. Other columns are ignored.
    With ``tell_left_out`` also ``left_out BIGINT``, the values too large for ``total`` (see ``left_out``).
    """
    rows = df.select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(value).alias("v"))
    heavy = materialize(heavy_keys(rows, "k", share), "heavy-keys")  # both parts below read it
    hot, cold = split_by_keys(rows.where(F.col("k").isNotNull()), heavy, ["k"])
    # per (key, member): counts combine before the shuffle and no group is larger than one member's rows
    pair = [F.count(F.lit(1)).alias("n"), exact_sum(F.col("v")).alias("t"), left_out(F.col("v")).alias("x")]
    salt = F.pmod(F.xxhash64("m"), F.lit(salts))
    hot_parts = (
        hot.groupBy("k", "m").agg(*pair)
        .groupBy("k", salt.alias("salt"))
        .agg(F.sum("n").alias("n"), F.count("m").alias("members"), F.sum("t").alias("t"), F.sum("x").alias("x"))
        .groupBy("k")
        .agg(F.sum("n").alias("n"), F.sum("members").alias("members"), F.sum("t").alias("t"), F.sum("x").alias("x"))
    )
    cold_parts = (
        cold.groupBy("k", "m").agg(*pair)
        .groupBy("k")
        .agg(F.sum("n").alias("n"), F.count("m").alias("members"), F.sum("t").alias("t"), F.sum("x").alias("x"))
    )
    more = [F.col("x").alias("left_out")] if tell_left_out else []
    return hot_parts.unionByName(cold_parts).select(
        F.col("k").alias(key), F.col("n").alias("rows"), "members", F.col("t").cast("double").alias("total"), *more
    )
