"""The N highest-scoring items of every group, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import materialize

#: Groups with at least this share of all rows are heavy, and so are those of HEAVY_ROWS rows with 1 / MOST_HEAVY of all.
HEAVY_SHARE, HEAVY_ROWS, MOST_HEAVY = 0.001, 10_000_000, 100_000
#: Rows of a heavy group that share a salt, about.
SALT_ROWS = 100_000


def scored_pairs(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row per (``g``, ``i``) with its highest score ``s``; rows with a null, or a NaN score, are left out.

    Combines before the shuffle; other columns, whatever their names, are dropped first.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).dropna()
    if (kind := dict(df.dtypes)[score]) in ("float", "double"):
        rows = rows.where(~F.isnan("s")).withColumn("s", F.col("s") + F.lit(0).cast(kind))  # -0.0 becomes 0.0
    return rows


def top_n(
    df: DataFrame, group: str, item: str, score: str, n: int = 10, heavy_share: float = HEAVY_SHARE, salt_rows: int = SALT_ROWS
) -> DataFrame:
    """Each group's first ``n`` items by score descending, then item ascending (all, if it has fewer).

    Exact row counts per group split the groups. A heavy one (at least ``heavy_share`` of all rows, or in very large
    tables HEAVY_ROWS; so there are at most MOST_HEAVY of them, which are broadcast) is spread over ``count / salt_rows`` salts by its items, range
    sorted by (group, salt), cut to ``n`` per salt and only then put together. The light groups go through an
    ordinary window, whose limit is applied before the shuffle as well. Both parts are united.

    Result: ``group``, ``item``, ``score`` and ``rank INT`` from 1. An item's score is the highest of its rows in the
    group, so repeated rows don't matter; ties are ordered by item, hence always alike. Rows with a null group, item
    or score or a NaN score don't count; an empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be positive")
    rows = scored_pairs(df, group, item, score)
    counts = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "group-sizes")
    total = counts.agg(F.sum("size")).first()[0] or 0
    least = max(2.0, min(heavy_share * total, max(HEAVY_ROWS, total / MOST_HEAVY)))
    salts = F.ceil(F.col("size") / F.lit(salt_rows)).cast("int")
    heavy = F.broadcast(counts.where(F.col("size") >= F.lit(least)).select(F.col("g").alias("hg"), salts.alias("salts")))
    best = F.max("s").alias("s")

    hot = rows.join(heavy, F.col("g") == F.col("hg")).groupBy("g", "i", "salts").agg(best)
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("i"), F.col("salts"))).repartitionByRange("g", "salt")
    first = [F.col("s").desc(), F.col("i").asc()]
    within = F.row_number().over(Window.partitionBy("g", "salt").orderBy(*first))
    survivors = salted.withColumn("rank", within).where(F.col("rank") <= n).select("g", "i", "s")

    light = rows.join(heavy, F.col("g") == F.col("hg"), "left_anti").groupBy("g", "i").agg(best)
    whole = F.row_number().over(Window.partitionBy("g").orderBy(*first))
    ranked = [part.withColumn("rank", whole).where(F.col("rank") <= n) for part in (survivors, light)]
    return ranked[0].unionByName(ranked[1]).select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank"
    )
