"""The edge log, its segments, its vertices and lookups in it.

An edge log has ``src``, ``dst``, ``etype``, ``weight`` and, where the order of inserts matters, ``seq`` (from 1) and
``ts``. Rows with a null end are rejected when a log is built. Within a segment identical rows are stored once; the
log keeps them, so counts of inserts remain true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("src", "dst")


def edge_log(df: DataFrame, src: Column, dst: Column, etype: Column, weight: Column, *more: Column) -> DataFrame:
    """An edge log of ``df``; weight 1.0 where it is null, rows without both ends left out."""
    return df.select(
        src.alias("src"), dst.alias("dst"), etype.alias("etype"), F.coalesce(weight.cast("double"), F.lit(1.0)).alias("weight"), *more
    ).where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def both_ways(log: DataFrame) -> DataFrame:
    """The log and its reverse."""
    rest = [c for c in log.columns if c not in ENDS]
    return log.unionByName(log.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def assign_segments(log: DataFrame, max_edges: int) -> DataFrame:
    """``log`` with ``segment_id``: a segment is closed by the insert that finds it full."""
    return log.withColumn("segment_id", F.floor((F.col("seq") - 1) / F.lit(max_edges)).cast("long"))


def segment_meta(segmented: DataFrame) -> DataFrame:
    """(``segment_id``, ``created_at``, ``edge_count``, ``active``): created by its first insert; the last is active."""
    meta = segmented.groupBy("segment_id").agg(F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("edge_count"))
    # a row per segment, so one window may look at all of them
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return meta.withColumn("active", F.col("segment_id") == F.max("segment_id").over(every))


def expired_segments(meta: DataFrame, cutoff: Column) -> DataFrame:
    """The closed segments created before ``cutoff``."""
    return meta.where(~F.col("active") & (F.col("created_at") < cutoff))


def live_log(segmented: DataFrame, cutoff: Column) -> DataFrame:
    """The log without the expired segments."""
    gone = expired_segments(segment_meta(segmented), cutoff).select("segment_id")
    return segmented.join(gone, "segment_id", "left_anti")


def stored_edges(log: DataFrame) -> DataFrame:
    """The edges as stored: identical rows of a segment once."""
    keys = [c for c in ("segment_id", "src", "dst", "etype", "weight") if c in log.columns]
    return log.select(*keys).distinct()


def vertices(log: DataFrame) -> DataFrame:
    """(``id``): every end that was ever inserted."""
    return log.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def first_seen(log: DataFrame) -> DataFrame:
    """(``id``, ``seen``): each vertex with the place of its first appearance, a source before its target."""
    ends = F.array(F.struct(F.col("src").alias("id"), (F.col("seq") * 2).alias("at")), F.struct(F.col("dst").alias("id"), (F.col("seq") * 2 + 1).alias("at")))
    return log.select(F.inline(ends)).groupBy("id").agg(F.min("at").alias("seen"))


def vertex_dictionary(log: DataFrame) -> DataFrame:
    """(``id``, ``internal_id``): consecutive numbers from 0 by first appearance."""
    from graphloom.operators.sequence import number_rows

    return number_rows(first_seen(log), ["seen", "id"], "internal_id", 0).select("id", "internal_id")


def encode(df: DataFrame, dictionary: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, the number of the vertex in ``column``; null if the dictionary doesn't know it."""
    return df.join(dictionary.select(F.col("id").alias(column), F.col("internal_id").alias(out)), column, "left")


def decode(df: DataFrame, dictionary: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, the vertex that has the number in ``column``; null if there is none."""
    return df.join(dictionary.select(F.col("internal_id").alias(column), F.col("id").alias(out)), column, "left")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (``rows``, ``equal``): the distinct rows of ``a``, and whether ``b`` has just these; both have the same columns."""
    sides = a.withColumn("in_a__", F.lit(1)).unionByName(b.withColumn("in_a__", F.lit(0)))
    per = sides.groupBy(*a.columns).agg(F.max("in_a__").alias("a"), F.min("in_a__").alias("b"))
    return per.agg(F.count(F.when(F.col("a") == 1, 1)).alias("rows"), (F.count(F.when((F.col("a") == 0) | (F.col("b") == 1), 1)) == 0).alias("equal"))


def neighbours(edges: DataFrame, of: DataFrame | None = None, direction: str = "outgoing", etype: str | None = None) -> DataFrame:
    """(``id``, ``neighbour``), each once: the other ends of the edges of the vertices ``of`` (``id``; all if None)."""
    if direction not in ("outgoing", "incoming"):
        raise ValueError("direction must be outgoing or incoming")
    here, there = ("src", "dst") if direction == "outgoing" else ("dst", "src")
    rows = edges if etype is None else edges.where(F.col("etype") == etype)
    found = rows.select(F.col(here).alias("id"), F.col(there).alias("neighbour"))
    if of is not None:
        found = found.join(of.select("id").distinct(), "id", "left_semi")
    return found.distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """(``a`` < ``b``): vertices that point at each other."""
    pairs = edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi").where(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def ranked(scores: DataFrame, k: int, by: list[Column], partition: list[str], name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition, with their rank; the limit is applied before the shuffle as well."""
    order = Window.partitionBy(*partition).orderBy(*by)
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)
