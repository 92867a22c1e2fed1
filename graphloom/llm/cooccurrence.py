"""Items that appear together in a basket, and how much more often than by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize

#: Items of a basket that one task pairs with each other at once.
BLOCK_ITEMS = 256
#: Baskets of at least this many items, and of at least 1 / MOST_GIANT of all, are told to their items by broadcast.
GIANT_ITEMS, MOST_GIANT = 100_000, 10_000


def basket_items(df: DataFrame, basket: list[Column], item: str) -> DataFrame:
    """The distinct (basket, item) pairs as ``b0``, ``b1``, ... and ``item``; rows with a null in them are left out."""
    names = [f"b{k}" for k in range(len(basket))]
    rows = df.select(*[c.alias(name) for c, name in zip(basket, names)], F.col(item).alias("item"))
    return rows.dropna().distinct()


def basket_sizes(items: DataFrame) -> DataFrame:
    """The number of items of each basket, ``size``, combined before the shuffle."""
    return items.groupBy(*[c for c in items.columns if c != "item"]).agg(F.count(F.lit(1)).alias("size"))


def _in_blocks(items: DataFrame, large: DataFrame, block_items: int, giant: int) -> DataFrame:
    """``items`` with ``blocks``, the number of blocks their basket is cut into: 1 unless it is in ``large``.

    Giant baskets, of which there are at most MOST_GIANT, meet their items by broadcast, so these stay where they are;
    the other large ones do so in an ordinary join.
    """
    keys = [c for c in items.columns if c != "item"]
    blocks = F.ceil(F.col("size") * 2 / F.lit(block_items)).cast("int").alias("blocks")
    giants = large.where(F.col("size") >= giant).select(*keys, blocks)
    others = large.where(F.col("size") < giant).select(*keys, blocks)
    met = items.join(F.broadcast(giants), keys)
    rest = items.join(F.broadcast(giants.select(*keys)), keys, "left_anti").join(others, keys, "left")
    return met.unionByName(rest).withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def pair_counts(items: DataFrame, large: DataFrame, block_items: int = BLOCK_ITEMS, giant: int = GIANT_ITEMS) -> DataFrame:
    """Baskets that hold both items of a pair: ``item_a`` < ``item_b``, ``n_both BIGINT``.

    ``items`` has distinct (basket, item) rows and ``large`` the sizes of the baskets of more than ``block_items``; both
    are read twice, so pass materialized ones. A large basket is cut into blocks by a hash of the item, and each pair of
    blocks is a tile; any other basket is one tile. Tiles are what is grouped: no task holds a basket larger than a
    tile, and every pair of a basket stands in one of its tiles. Counts combine before the shuffle.
    """
    keys = [c for c in items.columns if c != "item"]
    cut = _in_blocks(items, large, block_items, giant).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    there = (F.col("block") == F.greatest("block", "other")) & (F.col("block") != F.col("other"))
    tiles = spread.groupBy(*keys, lo, hi).agg(
        F.sort_array(F.collect_list(F.when(~there, F.col("item")))).alias("mine"), F.collect_list(F.when(there, F.col("item"))).alias("theirs")
    ).where((F.col("lo") < F.col("hi")) | (F.size("mine") > 1))
    one = tiles.select("lo", "hi", "mine", "theirs", F.posexplode("mine").alias("at", "p"))
    # within one block: later items only; between two: from the lower block to the higher
    partners = F.when(F.col("lo") == F.col("hi"), F.slice("mine", F.col("at") + 2, F.size("mine"))).otherwise(F.col("theirs"))
    pairs = one.select("p", F.explode(partners).alias("q")).select(F.least("p", "q").alias("item_a"), F.greatest("p", "q").alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_both"))


def associations(
    df: DataFrame, basket: list[Column], item: str, min_both: int = 1, min_lift: float = 0.0, block_items: int = BLOCK_ITEMS, giant: int = GIANT_ITEMS
) -> DataFrame:
    """Pairs of items found together in at least ``min_both`` baskets, with lift and pointwise mutual information.

    Result: ``item_a`` < ``item_b``, ``n_both``, ``n_a``, ``n_b`` (baskets holding both, either), ``n_baskets``,
    ``lift`` = n_both * n_baskets / (n_a * n_b) and ``pmi`` = log2(lift), for pairs whose lift is at least
    ``min_lift``; the comparison is made on whole numbers where ``min_lift`` is one. The threshold on ``n_both`` is
    applied to the counted pairs before the marginals are joined. An item repeated in a basket counts once; rows with
    a null in the basket's columns or the item don't count; an empty table has no pairs. ``df`` is read once.
    """
    items = materialize(basket_items(df, basket, item), "basket-items")
    sizes = materialize(basket_sizes(items), "basket-sizes")
    n_baskets, n_items = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    large = materialize(sizes.where(F.col("size") > block_items), "large-baskets")
    counts = pair_counts(items, large, block_items, max(giant, n_items // MOST_GIANT)).where(F.col("n_both") >= min_both)
    per_item = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    a, b = (per_item.select(F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    out = counts.join(a, "item_a").join(b, "item_b")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    together = F.col("n_both").cast("double") * F.lit(float(n_baskets))
    apart = F.col("n_a").cast("double") * F.col("n_b").cast("double")
    if min_lift == int(min_lift):
        keep = wide("n_both") * F.lit(n_baskets).cast("decimal(19,0)") >= F.lit(int(min_lift)).cast("decimal(5,0)").cast("decimal(38,0)") * (wide("n_a") * wide("n_b"))
    else:
        keep = together >= F.lit(min_lift) * apart
    return out.where(keep).select(
        "item_a", "item_b", "n_both", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"),
        (together / apart).alias("lift"), F.log2(together / apart).alias("pmi"),
    )


def utc_day(at: str) -> Column:
    """The UTC date of a timestamp as days since 1970, whatever the session's time zone."""
    return F.floor(F.unix_micros(F.col(at)) / F.lit(86_400_000_000)).cast("int")
