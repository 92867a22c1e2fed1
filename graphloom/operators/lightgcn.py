"""Embeddings on a bipartite graph: weighted normalized adjacency, propagation and scoring, all sparse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.sequence import number_rows
from graphloom.operators.storage import ranked


class EmptyGraph(ValueError):
    """There are no users, no items or no edges between them."""


def split_vertices(all_vertices: DataFrame, user_prefix: str) -> tuple[DataFrame, DataFrame]:
    """Users are the vertices whose id begins with the prefix, items are the others."""
    is_user = F.col("id").startswith(user_prefix)
    return all_vertices.where(is_user), all_vertices.where(~is_user)


def row_index(all_vertices: DataFrame, user_prefix: str) -> DataFrame:
    """(``id``, ``side``, ``row``): consecutive rows from 0, users in the order of their ids, then items in theirs."""
    sided = all_vertices.select("id", F.when(F.col("id").startswith(user_prefix), "user").otherwise("item").alias("side"))
    return number_rows(sided.withColumn("second", F.col("side") == "item"), ["second", "id"], "row", 0).select("id", "side", "row")


def weighted_pairs(edges: DataFrame, user_prefix: str) -> DataFrame:
    """(``user``, ``item``, ``weight``): the weights of the edges between a user and an item in either direction, summed.

    Pairs of weight 0 or less are pairs all the same; edges within one side are ignored.
    """
    from_user, to_user = F.col("src").startswith(user_prefix), F.col("dst").startswith(user_prefix)
    crossing = edges.where(from_user != to_user)
    return crossing.groupBy(
        F.when(from_user, F.col("src")).otherwise(F.col("dst")).alias("user"), F.when(from_user, F.col("dst")).otherwise(F.col("src")).alias("item")
    ).agg(F.sum("weight").alias("weight"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(``row``, ``col``, ``w``): each pair as two entries."""
    two = F.array(
        F.struct(F.col("user").alias("row"), F.col("item").alias("col"), F.col("weight").alias("w")),
        F.struct(F.col("item").alias("row"), F.col("user").alias("col"), F.col("weight").alias("w")),
    )
    return pairs.select(F.inline(two))


def weighted_degrees(entries: DataFrame) -> DataFrame:
    """(``id``, ``degree``): the row sums."""
    return entries.groupBy(F.col("row").alias("id")).agg(F.sum("w").alias("degree"))


def normalized_adjacency(pairs: DataFrame) -> DataFrame:
    """(``row``, ``col``, ``w``): D^-1/2 W D^-1/2, where a degree in (0, 1) counts as 1 and one of 0 or less gives 0."""
    entries = symmetric(pairs)
    d = weighted_degrees(entries)
    scale = F.when(F.col("degree") > 0, 1 / F.sqrt(F.greatest(F.col("degree"), F.lit(1.0)))).otherwise(F.lit(0.0))
    scaled = d.select("id", scale.alias("s"))
    rows = scaled.select(F.col("id").alias("row"), F.col("s").alias("s_row"))
    cols = scaled.select(F.col("id").alias("col"), F.col("s").alias("s_col"))
    return entries.join(rows, "row").join(cols, "col").select("row", "col", (F.col("w") * F.col("s_row") * F.col("s_col")).alias("w"))


def propagate(embeddings: DataFrame, adjacency: DataFrame, layers: int) -> DataFrame:
    """(``id``, ``d``, ``x``): the mean of the embeddings over 0 to ``layers`` steps along the adjacency.

    ``embeddings`` is (``id``, ``d``, ``x``), an entry per dimension. Each step is a join and an aggregation; the sum
    over the steps travels with them, so the plan has one branch.
    """
    keep = embeddings.select(F.col("id").alias("row"), F.col("id").alias("col")).distinct().select("row", "col", F.lit(0.0).alias("w"), F.lit(True).alias("keeps"))
    entries = adjacency.select("row", "col", "w", F.lit(False).alias("keeps")).unionByName(keep)
    state = embeddings.select("id", "d", F.col("x").alias("now"), F.col("x").alias("total"))
    for _ in range(layers):
        moved = state.join(entries, F.col("id") == F.col("col")).select(
            F.col("row").alias("id"), "d", (F.col("now") * F.col("w")).alias("step"), F.when(F.col("keeps"), F.col("total")).otherwise(F.lit(0.0)).alias("kept")
        )
        state = moved.groupBy("id", "d").agg(F.sum("step").alias("now"), (F.sum("kept") + F.sum("step")).alias("total"))
    return state.select("id", "d", (F.col("total") / (layers + 1)).alias("x"))


def as_vectors(entries: DataFrame) -> DataFrame:
    """(``id``, ``v``): the entries of each vertex as an array in the order of ``d``."""
    return entries.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("v"))


#: Vectors of a side that one task holds at once.
SCORE_BLOCK = 4_096


def score_top_k(users: DataFrame, items: DataFrame, top_k: int = 20, seen: DataFrame | None = None, block: int = SCORE_BLOCK) -> DataFrame:
    """(``user``, ``item``, ``score``, ``rank``): the items with the highest dot products with each user.

    ``users`` and ``items`` are (``id``, ``v``) with vectors of one length. Both sides are cut into blocks, each pair of
    blocks is one matrix product, and only the best ``top_k`` of a pair of blocks go on; neither side is broadcast.
    ``seen`` (``user``, ``item``) is left out before the cut. Scores are rounded to 6 decimals; ties go by item.
    """
    u_blocks, i_blocks = max(1, -(-users.count() // block)), max(1, -(-items.count() // block))
    vector = F.col("v").cast("array<double>").alias("v")
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<string>").alias("seen")
    asking = users.select("id", vector, part(u_blocks).alias("row"), every(i_blocks).alias("col"), F.lit(True).alias("asks"))
    if seen is None:
        asking = asking.withColumn("seen", F.lit(None).cast("array<string>"))
    else:
        # a user's seen items, by the block of items they fall into, so that no row carries more than a block
        there = F.pmod(F.xxhash64("item"), F.lit(i_blocks)).cast("int")
        listed = seen.groupBy(F.col("user").alias("id"), there.alias("col")).agg(F.collect_set("item").alias("seen"))
        asking = asking.join(listed, ["id", "col"], "left")
    answering = items.select("id", vector, every(u_blocks).alias("row"), part(i_blocks).alias("col"), F.lit(False).alias("asks"), none)
    columns = ["id", "v", "row", "col", "asks", "seen"]

    def multiply(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id", kind="stable")
        a, b = tile[tile["asks"]], tile[~tile["asks"]]
        if a.empty or b.empty:
            return pd.DataFrame({"user": [], "item": [], "score": []}).astype({"user": str, "item": str, "score": float})
        names = b["id"].to_numpy()
        at = {name: k for k, name in enumerate(names)}
        out = []
        step = max(1, 4_000_000 // len(b))
        right = np.stack(b["v"].to_numpy()).T
        for lo in range(0, len(a), step):
            part = a.iloc[lo : lo + step]
            scores = np.round(np.stack(part["v"].to_numpy()) @ right, 6)
            for k, known in enumerate(part["seen"]):
                if known is not None:
                    scores[k, [at[i] for i in known if i in at]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :top_k]
            found = np.take_along_axis(scores, best, 1).ravel()
            keep = found > -np.inf
            out.append(pd.DataFrame({"user": np.repeat(part["id"].to_numpy(), best.shape[1])[keep], "item": names[best].ravel()[keep], "score": found[keep]}))
        return pd.concat(out, ignore_index=True)

    best = asking.select(columns).unionByName(answering.select(columns)).groupBy("row", "col").applyInPandas(multiply, "user string, item string, score double")
    return ranked(best, top_k, [F.col("score").desc(), F.col("item").asc()], ["user"])
