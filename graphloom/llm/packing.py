"""Packing items of varying length into containers of a fixed capacity.

Hierarchical multi-length packing. Items are routed to tiers of window lengths that halve down from the capacity. The
longest tier is packed first and its gaps are filled from the shorter ones; a shorter tier keeps the windows that come
out nearly full, and what is left is packed together at full length. Windows of a tier fit a container a whole number
of times, so a container always has the one capacity. Containers are dealt to step groups of even cost.

The plan is made over the histogram of item sizes, whose length is bounded by the capacity, never over the items; the
items find their place by their rank among those of equal size.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.prefix import running_total
from graphloom.runtime import materialize

CAPACITY = 2_048
#: Halvings of the capacity that are tiers, besides the capacity itself.
SHORTER_TIERS = 2
#: The unused part of a shorter tier's window that is still accepted.
SLACK = 1 / 256
#: Containers of a step group.
GROUP_CONTAINERS = 64


@dataclass
class Windows:
    """``count`` windows of length ``tier``, each holding the sizes ``sizes`` in this order."""

    tier: int
    sizes: tuple[int, ...]
    count: int

    @property
    def cost(self) -> int:
        """The attention cost of a full container of such windows."""
        return sum(s * s for s in self.sizes)


@dataclass
class _Stock:
    """Items left, by size."""

    left: dict[int, int]
    sizes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sizes = sorted(s for s, n in self.left.items() if n > 0)

    def largest(self, upto: int) -> int | None:
        at = bisect_right(self.sizes, upto)
        return self.sizes[at - 1] if at else None

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.remove(size)

    def fill(self, window: int, anchor: int) -> tuple[tuple[int, ...], int]:
        """A window begun with ``anchor`` and filled with the largest items that fit, and how often it can be made."""
        used: dict[int, int] = {}
        order, gap, size = [], window, anchor
        while size is not None:
            n = min(gap // size, self.left[size] - used.get(size, 0))
            used[size] = used.get(size, 0) + n
            order += [size] * n
            gap -= n * size
            size = self._next(gap, used)
        return tuple(order), min(self.left[s] // n for s, n in used.items())

    def _next(self, gap: int, used: dict[int, int]) -> int | None:
        size = self.largest(gap)
        while size is not None and self.left[size] <= used.get(size, 0):
            size = self.largest(size - 1)
        return size


def tiers_of(capacity: int, shorter: int = SHORTER_TIERS) -> list[int]:
    """The window lengths, longest first."""
    if capacity < 1 or capacity % (1 << shorter):
        raise ValueError(f"the capacity must be a positive multiple of {1 << shorter}")
    return [capacity >> k for k in range(shorter + 1)]


def plan_windows(histogram: dict[int, int], capacity: int, shorter: int = SHORTER_TIERS, slack: float = SLACK) -> list[Windows]:
    """Windows that hold all items of the histogram (size to count, sizes from 1 to ``capacity``).

    Every distinct window uses up the last item of a size (or all but fewer than it needs), so their number is bounded
    by the capacity, not by the items.
    """
    stock = _Stock(dict(histogram))
    tiers = tiers_of(capacity, shorter)
    plan: list[Windows] = []
    for tier, below in zip(tiers, [*tiers[1:], 0]):
        upto = tier
        while (anchor := stock.largest(upto)) is not None and anchor > below:
            sizes, n = stock.fill(tier, anchor)
            if tier < capacity:
                n -= n % (capacity // tier)  # only whole containers; the rest is packed with what is left
                if not n or tier - sum(sizes) > slack * tier:
                    upto = anchor - 1
                    continue
            for size in sizes:
                stock.take(size, n)
            plan.append(Windows(tier, sizes, n))
    while (anchor := stock.largest(capacity)) is not None:
        sizes, n = stock.fill(capacity, anchor)
        for size in sizes:
            stock.take(size, n)
        plan.append(Windows(capacity, sizes, n))
    return plan


def _slots(plan: list[Windows], capacity: int) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """Where the items of each size go: size, first and last rank, tier, first window and items per window, offsets."""
    rows, used, container = [], {}, 0
    # costly containers first, so that dealing them back and forth evens out the groups
    for w in sorted(plan, key=lambda w: (-w.cost * (capacity // w.tier), w.tier, w.sizes)):
        at, places = 0, {}
        for size in w.sizes:
            places.setdefault(size, []).append(at)
            at += size
        first = container * (capacity // w.tier)
        for size, offsets in places.items():
            lo = used.get(size, 0)
            used[size] = lo + w.count * len(offsets)
            rows.append((size, lo, used[size], w.tier, first, len(offsets), offsets))
        container += -(-w.count // (capacity // w.tier))
    return rows


_SLOT_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("slot_size", "lo", "hi", "tier", "first_window", "per_window")]
    + [T.StructField("offsets", T.ArrayType(T.LongType()), False)]
)


def pack(
    sizes: DataFrame, item: str, size: str, capacity: int = CAPACITY, shorter: int = SHORTER_TIERS, group_containers: int = GROUP_CONTAINERS
) -> DataFrame:
    """Assign every item to containers of ``capacity``.

    Result, a row per piece: ``item``, ``piece INT`` from 0, ``piece_start`` (its first unit within the item),
    ``n_tokens``, ``tier`` (window length), ``container``, ``position`` (its first unit within the container) and
    ``step_group``. Only an item larger than the capacity is cut: into pieces that fill containers and a rest. No
    two pieces overlap and no container holds more than ``capacity``. Items of null size or of size 0 or less take no
    room and get one row without a container. ``item`` must be unique; an empty table gives an empty result.
    ``sizes`` is read several times: pass a materialized one. Other columns are ignored.
    """
    items = sizes.select(F.col(item).alias("id"), F.col(size).cast("long").alias("size"))
    some = items.where(F.col("size") > 0)
    whole, left = F.floor(F.col("size") / F.lit(capacity)), F.col("size") % capacity
    # full pieces of large items, and what is left of every item
    rests = some.where(left > 0).select("id", whole.cast("int").alias("piece"), (whole * capacity).alias("piece_start"), left.alias("n"), F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("one"))
    full = some.where(F.col("size") >= capacity).select("id", F.xxhash64("id").alias("h"), whole.cast("long").alias("whole"))
    # at most `capacity` rows come to the driver
    histogram = {r["n"]: r["count"] for r in rests.groupBy("n").count().collect()}
    if n_full := full.agg(F.sum("whole")).first()[0]:
        histogram[capacity] = n_full
    plan = plan_windows(histogram, capacity, shorter)
    n_containers = sum(-(-w.count // (capacity // w.tier)) for w in plan)
    groups = max(1, -(-n_containers // group_containers))
    spark = sizes.sparkSession
    slots = F.broadcast(spark.createDataFrame(_slots(plan, capacity), _SLOT_SCHEMA))
    # a large item takes consecutive ranks, so its full pieces need none of their own
    first = running_total(full, [], "h", ["id"], "whole", "first")
    pieces = first.select("id", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("nth")).select(
        "id", F.col("nth").cast("int").alias("piece"), (F.col("nth") * capacity).alias("piece_start"), F.lit(capacity).cast("long").alias("n"), (F.col("first") + F.col("nth")).alias("rank")
    )
    columns = ["id", "piece", "piece_start", "n", "rank"]
    ranked = running_total(rests, ["n"], "h", ["id"], "one", "rank").select(columns).unionByName(pieces.select(columns))
    c = F.col
    inside = c("rank") - c("lo")
    window = c("first_window") + F.floor(inside / c("per_window"))
    per_container = F.lit(capacity) / c("tier")
    container = F.floor(window / per_container).cast("long")
    position = (window - container * per_container) * c("tier") + F.element_at("offsets", (inside % c("per_window") + 1).cast("int"))
    placed = ranked.join(slots, (c("n") == c("slot_size")) & (c("rank") >= c("lo")) & (c("rank") < c("hi"))).select(
        "id", "piece", c("piece_start").cast("long").alias("piece_start"), c("n").alias("n_tokens"), "tier", container.alias("container"), position.cast("long").alias("position")
    )
    # dealt back and forth: 0 1 2 2 1 0 0 1 2 ...
    turn, place = F.floor(c("container") / groups), c("container") % groups
    grouped = placed.withColumn("step_group", F.when(turn % 2 == 0, place).otherwise(groups - 1 - place).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)
    without = items.where(c("size").isNull() | (c("size") <= 0)).select(
        "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("piece_start"), F.lit(0).cast("long").alias("n_tokens"),
        none("long").alias("tier"), none("long").alias("container"), none("long").alias("position"), none("long").alias("step_group"),
    )
    return grouped.unionByName(without).withColumnRenamed("id", item)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Per window length: ``tier``, ``containers``, ``pieces``, ``tokens``, ``fill`` (tokens / room)."""
    per = packed.where(F.col("container").isNotNull()).groupBy("tier", "container").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens")
    )
    return per.groupBy("tier").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        (F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )


def packing_checks(packed: DataFrame, sizes: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold of ``packed``, a result of ``pack`` for ``sizes``; both are read several times.

    ``over_capacity``: containers that hold more than the capacity; ``overlapping``: pieces that begin before the one
    before them ends; ``wrongly_cut``: items no larger than the capacity in several pieces; ``of_two_tiers``: containers
    of two window lengths; ``texts`` and ``without_container``: items, and those that take no room;
    ``every_token_once``: the pieces of each item follow each other without a gap and add up to it; ``nearly_full``: at
    least 99 % of the room is used, the last container aside; ``even_groups``: the containers of two step groups differ
    by 2 at most.
    """
    c = F.col
    held = packed.where(c("container").isNotNull())
    # a container has at most `capacity` pieces, and an item as many as its size asks for
    in_container = Window.partitionBy("container").orderBy("position")
    touching = held.withColumn("ends", F.lag(c("position") + c("n_tokens")).over(in_container))
    per_container = touching.groupBy("container").agg(
        F.sum("n_tokens").alias("used"), F.count(F.when(c("position") < c("ends"), 1)).alias("overlaps"), F.countDistinct("tier").alias("tiers"), F.max("step_group").alias("g")
    )
    room = per_container.agg(
        F.count(F.when(c("used") > capacity, 1)).alias("over_capacity"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlapping"), F.count(F.when(c("tiers") > 1, 1)).alias("of_two_tiers"),
        (F.coalesce(F.sum("used"), F.lit(0)) >= F.lit(0.99 * capacity) * (F.count(F.lit(1)) - 1)).alias("nearly_full"),
    )
    groups = per_container.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg((F.coalesce(F.max("n") - F.min("n"), F.lit(0)) <= 2).alias("even_groups"))
    per_item = packed.groupBy(c(item).alias("id")).agg(
        F.count("container").alias("pieces"), F.sum("n_tokens").alias("placed"), F.min("piece_start").alias("first"), F.max(c("piece_start") + c("n_tokens")).alias("last"),
        F.sum(F.when(c("n_tokens") == capacity, 0).otherwise(1)).alias("partial"), F.countDistinct("piece").alias("numbers"), F.count(F.lit(1)).alias("rows"),
    )
    whole = F.coalesce(c(size), F.lit(0))
    sound = (c("placed") == whole) & (c("first") == 0) & (c("last") == whole) & (c("partial") <= 1) & (c("numbers") == c("rows"))
    items = sizes.select(c(item).alias("id"), size).join(per_item, "id", "full").agg(
        F.count(F.when((whole <= capacity) & (c("pieces") > 1), 1)).alias("wrongly_cut"), F.count(F.lit(1)).alias("texts"), F.count(F.when(c("pieces") == 0, 1)).alias("without_container"),
        (F.count(F.when(F.coalesce(sound, F.lit(False)), 1)) == F.count(F.lit(1))).alias("every_token_once"),
    )
    parts = [part.withColumn("k", F.lit(1)) for part in (room, groups, items)]  # a row each
    return parts[0].join(parts[1], "k").join(parts[2], "k").select(
        "over_capacity", "overlapping", "wrongly_cut", "of_two_tiers", "texts", "without_container", "every_token_once", "nearly_full", "even_groups"
    )


def pack_texts(docs: DataFrame, item: str, text: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` over whole texts sized in tokens; the sizes are written once to the shared folder."""
    from graphloom.llm.tokens import count_tokens

    sized = materialize(count_tokens(docs, text, tokenizer, (item,)), "token-sizes")
    return pack(sized, item, "n_tokens", capacity)
