"""Rankers over stored edges. Each takes all its seeds at once.

Walks and SALSA on a graph that a task can hold are computed in tasks (``walks``); on a larger one, each is a plain
DataFrame plan of joins, with the same results.

Scores are ordered descending and equal ones by id ascending. Sums of fractions are compared after rounding to nine
decimals, so that the order of addition can't decide a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import draw, ratio
from graphloom.operators import walks
from graphloom.operators.sequence import number_rows
from graphloom.operators.storage import ranked, vertices
from graphloom.runtime import materialize

RESET = 0.15
WALK_LENGTH = 10
#: Targets of a source that one task pairs with the seeds among them.
HUB_TARGETS = 4_096
#: Steps after which a walk's state is written and its plan begins anew.
CUT_EVERY = 10


def _best(value: str) -> list[Column]:
    return [F.round(value, 9).desc(), F.col("id").asc()]


def transitions(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """(``src``, ``dst``, ``p``): a step goes along any stored edge row alike, so parallel edges count as often.

    With ``weighted`` it goes along an edge in proportion to its weight, and never along one without a positive weight.
    """
    used = edges.where(F.col("weight") > 0) if weighted else edges
    amount = F.sum("weight") if weighted else F.count(F.lit(1))
    rows = used.groupBy("src", "dst").agg(amount.alias("n"))
    out = used.groupBy("src").agg(amount.alias("out"))
    return rows.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("p"))


def _numbered(edges: DataFrame) -> DataFrame:
    """(``id``, ``n``): the vertices with consecutive numbers in the order of their ids; written once."""
    return materialize(number_rows(vertices(edges), ["id"], "n", 0).select("id", "n"), "walk-vertices")


def _flows(edges: DataFrame, numbers: DataFrame, reset: float, weighted: bool) -> DataFrame:
    """(``src``, ``dst``, ``w``, ``keeps``): where a share ``w`` of what stands at a vertex goes, by the vertices' numbers.

    A null ``dst`` is the seed: what is reset goes there, and all that stands at a vertex without a way out. One row a
    vertex, with ``keeps``, carries its visits on.
    """
    there = lambda c: numbers.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    p = transitions(edges, weighted).join(there("src"), "src").join(there("dst"), "dst")
    steps = p.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), (F.col("p") * (1 - reset)).alias("w"), F.lit(False).alias("keeps"))
    leaving = (edges.where(F.col("weight") > 0) if weighted else edges).select(F.col("src").alias("id")).distinct().withColumn("leaves", F.lit(True))
    home = F.struct(F.lit(None).cast("long").alias("dst"), F.when(F.col("leaves"), F.lit(reset)).otherwise(F.lit(1.0)).alias("w"), F.lit(False).alias("keeps"))
    keep = F.struct(F.col("n").alias("dst"), F.lit(0.0).alias("w"), F.lit(True).alias("keeps"))
    return steps.unionByName(numbers.join(leaving, "id", "left").select(F.col("n").alias("src"), F.inline(F.array(home, keep))))


def _visits(edges: DataFrame, numbers: DataFrame, seeds: DataFrame, walk_length: int, reset: float, weighted: bool) -> DataFrame:
    """``expected_visits`` by the vertices' numbers."""
    if walk_length < 1:
        raise ValueError("walk_length must be positive")
    # every step reads the same flows: written once, so that a step is a scan (or a broadcast, if they are small), a join and an aggregation
    flows = materialize(_flows(edges, numbers, reset, weighted), "flows")
    one = F.lit(1.0)
    state = seeds.select("id").distinct().join(numbers, "id").select(F.col("n").alias("seed"), F.col("n").alias("id"), one.alias("mass"), one.alias("visits"))
    for step in range(1, walk_length):
        if step % CUT_EVERY == 0:
            state = materialize(state, "visits")
        moved = state.join(flows, F.col("id") == F.col("src")).select(
            "seed", F.coalesce("dst", "seed").alias("id"), (F.col("mass") * F.col("w")).alias("m"), F.when(F.col("keeps"), F.col("visits")).otherwise(F.lit(0.0)).alias("v")
        )
        state = moved.groupBy("seed", "id").agg(F.sum("m").alias("mass"), (F.sum("v") + F.sum("m")).alias("visits"))
    return state.select("seed", "id", "visits")


def _named(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """``df`` with ids for the numbers in ``seed`` and ``id``."""
    for column in ("seed", "id"):
        df = df.withColumnRenamed(column, "n").join(numbers.withColumnRenamed("id", f"{column}__"), "n").drop("n").withColumnRenamed(f"{column}__", column)
    return df


def expected_visits(edges: DataFrame, seeds: DataFrame, walk_length: int = WALK_LENGTH, reset: float = RESET, weighted: bool = False) -> DataFrame:
    """(``seed``, ``id``, ``visits``): the expected visits of a walk of ``walk_length`` vertices from each seed.

    After each visit the walk returns to the seed with probability ``reset``, else follows an edge row at random;
    without one it returns too. The visits of a seed add up to ``walk_length``. ``seeds`` has ``id``; unknown ones
    have no result. Where no task can hold the graph: one join and one aggregation per step, over numbers in place of ids.
    """
    if walk_length >= 1 and 0 <= reset < 1 and (packed := walks.packed_graph(edges, weighted)):
        return walks.expected_visits(packed, seeds, walk_length, reset)
    numbers = _numbered(edges)
    return _named(_visits(edges, numbers, seeds, walk_length, reset, weighted), numbers).select("seed", "id", "visits")


def simulated_visits(
    edges: DataFrame, seeds: DataFrame, num_walks: int = 1000, walk_length: int = WALK_LENGTH, reset: float = RESET, random_seed: int = 42
) -> DataFrame:
    """``expected_visits`` as counted in ``num_walks`` reproducible walks; the visits of a seed add up exactly.

    Every choice is drawn from a hash of (random seed, seed vertex, walk, step). Out-edges are numbered by their places
    in a range-partitioned order, so no task holds a vertex's edges, and a walker meets its next vertex by an equi-join
    on (vertex, number), which spreads even a vertex of very many edges. Where a task can hold the graph, it takes all
    walks of its seeds, and only their counts leave it.
    """
    if num_walks < 1 or walk_length < 1:
        raise ValueError("num_walks and walk_length must be positive")
    if packed := walks.packed_graph(edges):
        return walks.simulated_visits(packed, seeds, num_walks, walk_length, reset, random_seed)
    placed = materialize(number_rows(edges.select("src", "dst", "etype", "weight"), ["src", "dst", "etype", "weight"], "place"), "placed-edges")
    first = materialize(placed.groupBy("src").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("out")), "out-degrees")
    numbered = placed.join(first, "src").select("src", "dst", (F.col("place") - F.col("first")).alias("nth"))
    out = first.select(F.col("src").alias("at"), "out")
    known = vertices(placed)
    walkers = (
        seeds.select("id").distinct().join(known, "id", "left_semi")
        .select(F.col("id").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(num_walks))).alias("walk"))
        .select("seed", "walk", F.col("seed").alias("at"), F.array("seed").alias("path"))
    )
    for step in range(1, walk_length):
        if step % CUT_EVERY == 0:
            walkers = materialize(walkers, "walkers")
        key = (F.lit(random_seed), F.col("seed"), F.col("walk"), F.lit(step))
        stays = (draw(*key, 0) >= int(reset * 2**32)) & F.col("out").isNotNull()
        choosing = walkers.join(out, "at", "left").withColumn("pick", F.when(stays, draw(*key, 1) % F.col("out")))
        moved = choosing.join(numbered, (F.col("at") == F.col("src")) & (F.col("pick") == F.col("nth")), "left")
        walkers = moved.select("seed", "walk", F.coalesce("dst", "seed").alias("at"), "path").withColumn("path", F.concat("path", F.array("at")))
    visited = walkers.select("seed", F.explode("path").alias("id"))
    return visited.groupBy("seed", "id").agg(F.count(F.lit(1)).cast("double").alias("visits"))


def pagerank(edges: DataFrame, seeds: DataFrame, top_k: int = 100, walk_length: int = WALK_LENGTH, reset_prob: float = RESET, mode: str = "exact", num_walks: int = 1000, random_seed: int = 42, weighted: bool = False) -> DataFrame:
    """(``seed``, ``id``, ``score``, ``rank``): the most visited vertices, the seed left out; scores add up to 1.

    ``weighted`` steps (see ``transitions``) are for the exact mode.
    """
    if mode == "exact" and walk_length >= 1 and 0 <= reset_prob < 1 and (packed := walks.packed_graph(edges, weighted)):
        return walks.most_visited(packed, seeds, top_k, walk_length, reset_prob)
    if mode == "exact":
        numbers = _numbered(edges)
        visits = _visits(edges, numbers, seeds, walk_length, reset_prob, weighted)
    elif mode == "monte_carlo" and not weighted:
        visits = simulated_visits(edges, seeds, num_walks, walk_length, reset_prob, random_seed)
    else:
        raise ValueError("mode must be exact or, without weighted, monte_carlo")
    # numbers are in the order of ids, so ties are ordered alike by both
    kept = ranked(visits.where((F.col("id") != F.col("seed")) & (F.col("visits") > 0)), top_k, _best("visits"), ["seed"])
    whole = F.sum("visits").over(Window.partitionBy("seed"))
    scored = kept.select("seed", "id", (F.col("visits") / whole).alias("score"), "rank")
    return (_named(scored, numbers) if mode == "exact" else scored).select("seed", "id", "score", "rank")


def circle_of_trust(edges: DataFrame, seeds: DataFrame, size: int = 100, **walk: object) -> DataFrame:
    """(``seed``, ``id``): the vertices a seed visits most."""
    return pagerank(edges, seeds, top_k=size, **walk).select("seed", "id")


def salsa(
    edges: DataFrame, seeds: DataFrame, top_k: int = 20, seed_size: int = 100, iterations: int = 5, feedback: bool = False, exclude_self: bool = False, **walk: object
) -> DataFrame:
    """(``seed``, ``id``, ``score``, ``rank``): what the circle of trust points at.

    Every hub of the circle has an equal share, which it divides among its edge rows; members of the circle are no
    result. With ``feedback`` the shares go back to the hubs and forth again ``iterations`` times; without it, more
    iterations change nothing. The seed itself may be a result unless ``exclude_self``.
    """
    if iterations < 1:
        raise ValueError("iterations must be positive")
    plain = {"walk_length": WALK_LENGTH, "reset_prob": RESET} | {k: v for k, v in walk.items() if (k, v) not in (("mode", "exact"), ("weighted", False))}
    if plain.keys() <= {"walk_length", "reset_prob", "num_walks", "random_seed"} and plain["walk_length"] >= 1 and 0 <= plain["reset_prob"] < 1 and (packed := walks.packed_graph(edges)):
        return walks.salsa(packed, seeds, top_k, seed_size, iterations if feedback else 1, exclude_self, plain["walk_length"], plain["reset_prob"])
    # read by several branches below: computed once, at most seed_size rows per seed
    circle = materialize(circle_of_trust(edges, seeds, seed_size, **walk), "circle")
    size = F.count(F.lit(1)).over(Window.partitionBy("seed"))
    hubs = circle.select("seed", F.col("id").alias("hub"), (F.lit(1.0) / size).alias("share"))
    rows = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = hubs.join(rows.join(out, "src"), F.col("hub") == F.col("src")).select("seed", "hub", "share", "dst", "n", "out")

    def authorities(weighted: DataFrame) -> DataFrame:
        return weighted.groupBy("seed", "dst").agg(F.sum(F.col("share") * F.col("n") / F.col("out")).alias("score"))

    if feedback:
        links = materialize(links, "circle-links")
    scores = authorities(links)
    if feedback:
        received = links.groupBy("seed", "dst").agg(F.sum("n").alias("all_rows"))
        for _ in range(iterations - 1):
            back = links.join(scores, ["seed", "dst"]).join(received, ["seed", "dst"])
            share = back.groupBy("seed", "hub").agg(F.sum(F.col("score") * F.col("n") / F.col("all_rows")).alias("share"))
            scores = authorities(links.drop("share").join(share, ["seed", "hub"]))
    found = scores.withColumnRenamed("dst", "id").join(circle, ["seed", "id"], "left_anti")
    if exclude_self:
        found = found.where(F.col("id") != F.col("seed"))
    return ranked(found, top_k, _best("score"), ["seed"]).select("seed", "id", "score", "rank")


def similar_items(
    edges: DataFrame, seeds: DataFrame | None = None, normalize: str = "jaccard", degree: str = "overlap", min_overlap: int = 1, top_k: int = 20, hub_targets: int = HUB_TARGETS
) -> DataFrame:
    """(``seed``, ``id``, ``overlap``, ``score``, ``rank``): items that share sources with a seed item.

    ``seeds`` (``id``; all targets if None) are targets of edges. The overlap counts distinct sources of both.
    ``degree`` says what an item's own degree is: the overlap, as parity has it, or with ``global`` its distinct
    sources. ``normalize`` is raw, jaccard or cosine. The targets of a source of more than ``hub_targets`` are cut into
    blocks, which meet its seeds apart from each other.
    """
    if normalize not in ("raw", "jaccard", "cosine") or degree not in ("overlap", "global"):
        raise ValueError("unknown normalize or degree")
    pairs = materialize(edges.select("src", "dst").distinct(), "source-targets")
    per_source = pairs.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(hub_targets)).cast("int").alias("blocks"))
    hubs = materialize(per_source.where(F.col("blocks") > 1), "hubs")
    in_blocks = lambda df: df.join(hubs, "src", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    asked = pairs if seeds is None else pairs.join(seeds.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    mine = asked.select("src", F.col("dst").alias("seed"))
    theirs = pairs.select("src", F.col("dst").alias("id"))
    mine = in_blocks(mine).select("src", "seed", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    theirs = in_blocks(theirs).select("src", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    shared = mine.join(theirs, ["src", "block"]).where(F.col("id") != F.col("seed")).groupBy("seed", "id").agg(F.count(F.lit(1)).alias("overlap"))
    sources = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    found = shared.where(F.col("overlap") >= min_overlap).join(sources.select(F.col("dst").alias("seed"), F.col("degree").alias("d_seed")), "seed")
    d_item = F.col("overlap")
    if degree == "global":
        found = found.join(sources.select(F.col("dst").alias("id"), F.col("degree").alias("d_item")), "id")
        d_item = F.col("d_item")
    score = {
        "raw": F.col("overlap").cast("double"),
        "jaccard": ratio(F.col("overlap"), F.col("d_seed") + d_item - F.col("overlap")),
        "cosine": ratio(F.col("overlap"), F.sqrt(F.col("d_seed").cast("double") * d_item)),
    }[normalize]
    return ranked(found.withColumn("score", score), top_k, _best("score"), ["seed"]).select("seed", "id", "overlap", "score", "rank")


def global_rank(edges: DataFrame, all_vertices: DataFrame, top_k: int = 20, prefix: str | None = None, min_degree: int = 1) -> DataFrame:
    """(``id``, ``degree``, ``score``, ``rank``): vertices by distinct sources, relative to the largest kept.

    Every known vertex takes part, with degree 0 if nothing points at it.
    """
    known = all_vertices.select("id")
    targets = edges
    if prefix is not None:
        known, targets = known.where(F.col("id").startswith(prefix)), edges.where(F.col("dst").startswith(prefix))
    degrees = targets.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("degree"))
    counted = known.join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    kept = counted.where(F.col("degree") >= min_degree).orderBy(F.col("degree").desc(), "id").limit(top_k)
    whole = Window.orderBy(F.col("degree").desc(), "id")  # over top_k rows
    most = F.max("degree").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.select("id", "degree", ratio(F.col("degree"), most).alias("score"), F.row_number().over(whole).alias("rank"))
