"""Training of graph embeddings: Bayesian personalized ranking with Adam on the sparse normalized adjacency.

By default one graph is trained in one Arrow group, since every step depends on the one before; its memory is that of
the pairs plus a few matrices of nodes x dimensions. Several graphs train side by side. A graph too large for one task
is trained ``sharded``: the embeddings and the state of Adam stay in a table with a row per vertex, every step is a plan
of joins and sums over it, and only the vectors of a batch come to the driver.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import draw
from graphloom.operators.lightgcn import EmptyGraph, normalized_adjacency, row_index, weighted_pairs
from graphloom.operators.sequence import number_rows
from graphloom.runtime import materialize

# The usual constants of Adam and of the logarithm's guard.
BETA_1, BETA_2, EPSILON, LOG_GUARD = 0.9, 0.999, 1e-8, 1e-10
#: Entries of the adjacency multiplied at once, so that their products stay in the processor's cache.
BLOCK_ENTRIES = 2_000
#: A graph with at least this share of all pairs of a user and an item, and at most so many of them, is a dense matrix.
DENSE_SHARE, DENSE_CELLS = 0.04, 32_000_000
#: Vertices of the smaller side up to which two steps along a dense matrix are one matrix of that side.
DENSE_SIDE = 2_048


@dataclass(frozen=True)
class TrainingOptions:
    embedding_dim: int = 64
    layers: int = 3
    epochs: int = 1000
    batch_size: int = 1024
    learning_rate: float = 0.001
    regularization: float = 1e-4
    seed: int = 42
    #: More epochs are run where fewer draws than this many times the pairs would be made.
    draws_per_pair: float = 0.0
    #: Whether the graph is kept in tables instead of in one task; slower per step, without a bound on the graph.
    sharded: bool = False

    def __post_init__(self) -> None:
        for name in ("embedding_dim", "epochs", "batch_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.layers < 0:
            raise ValueError("layers must not be negative")


class SparseMatrix:
    """A symmetric matrix in rows of entries, multiplied by dense ones.

    Where the users and items are joined by many of the possible pairs, their rectangle is kept dense, and propagation
    takes all its steps on the smaller side: it passes the larger one twice, however many layers there are.
    """

    def __init__(self, users: np.ndarray, items: np.ndarray, weights: np.ndarray, n_users: int, n: int) -> None:
        rows, cols = np.concatenate([users, items + n_users]), np.concatenate([items + n_users, users])
        w = np.concatenate([weights, weights]).astype(np.float64)
        degree = np.bincount(rows, w, n)
        scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1.0)), 0.0)
        by_row = np.argsort(rows, kind="stable")
        self.cols, self.w = cols[by_row], (w * scale[rows] * scale[cols])[by_row]
        self.filled, self.starts = np.unique(rows[by_row], return_index=True)
        self.n = n
        self.rectangle: np.ndarray | None = None
        cells, few = n_users * (n - n_users), min(n_users, n - n_users)
        if 0 < cells <= DENSE_CELLS and few <= DENSE_SIDE and len(users) >= DENSE_SHARE * cells:
            sides = np.arange(n_users), np.arange(n_users, n)
            self.large, self.small = sides if n - n_users <= n_users else sides[::-1]
            ends = (users, items) if n - n_users <= n_users else (items, users)
            scaled = w[: len(users)] * scale[users] * scale[items + n_users]
            self.rectangle = np.bincount(ends[0] * len(self.small) + ends[1], scaled, cells).reshape(len(self.large), len(self.small))
            self.twice = self.rectangle.T @ self.rectangle

    def __matmul__(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros_like(dense)
        ends = np.append(self.starts[1:], len(self.cols))
        lo = 0
        while lo < len(self.filled):
            hi = max(lo + 1, int(np.searchsorted(ends, self.starts[lo] + BLOCK_ENTRIES, side="right")))
            a, b = self.starts[lo], ends[hi - 1]
            out[self.filled[lo:hi]] = np.add.reduceat(dense[self.cols[a:b]] * self.w[a:b, None], self.starts[lo:hi] - a, axis=0)
            lo = hi
        return out

    def propagate(self, dense: np.ndarray, layers: int) -> np.ndarray:
        """The mean of ``dense`` over 0 to ``layers`` steps."""
        if self.rectangle is not None:
            every = np.arange(self.n)
            return self.propagate_rows(every, dense, layers, every)
        total, step = dense.copy(), dense
        for _ in range(layers):
            step = self @ step
            total += step
        return total / (layers + 1)

    def propagate_rows(self, known: np.ndarray, values: np.ndarray, layers: int, wanted: np.ndarray) -> np.ndarray:
        """The rows ``wanted`` of what ``propagate`` makes of a matrix that has ``values`` in the rows ``known`` and else zeros; both ascend."""
        if self.rectangle is None:
            whole = values
            if len(known) < self.n:
                whole = np.zeros((self.n, values.shape[1]))
                whole[known] = values
            got = self.propagate(whole, layers)
            return got if len(wanted) == self.n else got[wanted]
        in_large = lambda rows: slice(*np.searchsorted(rows, [self.large[0], self.large[-1] + 1]))
        in_small = lambda rows: slice(*np.searchsorted(rows, [self.small[0], self.small[-1] + 1]))
        part = lambda rows: self.rectangle if len(rows) == len(self.large) else self.rectangle[rows - self.large[0]]
        given, asked = known[in_large(known)], wanted[in_large(wanted)]
        # what stands on the smaller side after each step; two steps on, it has passed the larger side and is back
        after = [np.zeros((len(self.small), values.shape[1])), part(given).T @ values[in_large(known)]]
        after[0][known[in_small(known)] - self.small[0]] = values[in_small(known)]
        while len(after) <= layers:
            after.append(self.twice @ after[-2])
        after = after[: layers + 1]
        out = np.empty((len(wanted), values.shape[1]))
        out[in_small(wanted)] = sum(after)[wanted[in_small(wanted)] - self.small[0]]
        out[in_large(wanted)] = part(asked) @ sum(after[:-1]) if layers else 0.0
        both, at, here = np.intersect1d(given, asked, assume_unique=True, return_indices=True)
        if len(both):
            out[in_large(wanted)][here] += values[in_large(known)][at]
        return out / (layers + 1)


def _summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows with the sums of the ``values`` that belong to each."""
    out = np.zeros((n, values.shape[1]))
    order = np.argsort(rows, kind="stable")
    filled, starts = np.unique(rows[order], return_index=True)
    out[filled] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _batch_gradient(e: np.ndarray, users: np.ndarray, liked: np.ndarray, other: np.ndarray) -> tuple[float, np.ndarray]:
    """The ranking loss of a batch and its gradient by the propagated embeddings ``e``."""
    u, p, q = e[users], e[liked], e[other]
    sigma = 1 / (1 + np.exp(-np.sum(u * (p - q), axis=1)))
    c = (-sigma * (1 - sigma) / (sigma + LOG_GUARD) / len(users))[:, None]
    g = _summed(np.concatenate([users, liked, other]), np.concatenate([c * (p - q), c * u, -c * u]), len(e))
    return float(-np.mean(np.log(sigma + LOG_GUARD))), g


def loss_and_gradient(
    e0: np.ndarray, adjacency: SparseMatrix, layers: int, users: np.ndarray, liked: np.ndarray, other: np.ndarray, regularization: float
) -> tuple[float, np.ndarray]:
    """The loss of a batch and its gradient by ``e0``. ``liked`` and ``other`` are rows of items.

    Propagation is linear and symmetric, so the gradient by the propagated embeddings is propagated once more. Only the
    rows of the batch are taken from the first propagation and given to the second.
    """
    every, rows = np.arange(adjacency.n), np.unique(np.concatenate([users, liked, other]))
    at = lambda some: np.searchsorted(rows, some)
    loss, g = _batch_gradient(adjacency.propagate_rows(every, e0, layers, rows), at(users), at(liked), at(other))
    slope = adjacency.propagate_rows(rows, g, layers, every)
    slope += 2 * regularization / e0.size * e0
    return loss + float(regularization * np.mean(e0**2)), slope


def train_arrays(users: np.ndarray, items: np.ndarray, weights: np.ndarray, n_users: int, n_items: int, options: TrainingOptions) -> tuple[np.ndarray, list[float]]:
    """The propagated embeddings (users first) and the loss of each step; an epoch is one batch drawn with replacement."""
    n, o = n_users + n_items, options
    rng = np.random.default_rng(o.seed)
    adjacency = SparseMatrix(users, items, weights, n_users, n)
    bound = np.sqrt(6 / (n + o.embedding_dim))
    e0 = rng.uniform(-bound, bound, (n, o.embedding_dim))
    first, second = np.zeros_like(e0), np.zeros_like(e0)
    size, losses = min(o.batch_size, len(users)), []
    epochs = max(o.epochs, int(np.ceil(o.draws_per_pair * len(users) / size)))
    for step in range(1, epochs + 1):
        pick = rng.integers(0, len(users), size)
        other = rng.integers(0, n_items, size) + n_users
        loss, g = loss_and_gradient(e0, adjacency, o.layers, users[pick], items[pick] + n_users, other, o.regularization)
        first *= BETA_1
        first += (1 - BETA_1) * g
        g *= g
        second *= BETA_2
        second += (1 - BETA_2) * g
        e0 -= o.learning_rate / (1 - BETA_1**step) * first / (np.sqrt(second / (1 - BETA_2**step)) + EPSILON)
        losses.append(loss)
    return adjacency.propagate(e0, o.layers), losses


def train(edges: DataFrame, all_vertices: DataFrame, user_prefix: str, options: TrainingOptions | None = None) -> DataFrame:
    """(``id``, ``side``, ``v ARRAY<DOUBLE>``): trained embeddings of all vertices, ``side`` being user or item.

    Raises EmptyGraph without users, items or edges between them.
    """
    o = options or TrainingOptions()
    pairs = weighted_pairs(edges, user_prefix)
    is_user = F.col("id").startswith(user_prefix)
    sides = {r["u"] for r in all_vertices.select(is_user.alias("u")).distinct().collect()}
    if sides != {True, False} or pairs.isEmpty():
        raise EmptyGraph("empty_graph")
    if o.sharded:
        return train_sharded(pairs, all_vertices, user_prefix, o)[0]
    columns = ["a", "b", "w"]
    rows = pairs.select(F.col("user").alias("a"), F.col("item").alias("b"), F.col("weight").alias("w"))
    named = all_vertices.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("w"))
    values = asdict(o)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(group.loc[group["b"].isna(), "a"].to_numpy().astype(str))
        prefix = np.char.startswith(ids, user_prefix)
        u_ids, i_ids = ids[prefix], ids[~prefix]
        known = group[group["b"].notna()].sort_values(["a", "b"], kind="stable")
        users = np.searchsorted(u_ids, known["a"].to_numpy().astype(str))
        items = np.searchsorted(i_ids, known["b"].to_numpy().astype(str))
        e, _ = train_arrays(users, items, known["w"].to_numpy(), len(u_ids), len(i_ids), TrainingOptions(**values))
        return pd.DataFrame({"id": np.concatenate([u_ids, i_ids]), "side": ["user"] * len(u_ids) + ["item"] * len(i_ids), "v": list(e)})

    return rows.select(columns).unionByName(named.select(columns)).groupBy(F.lit(0).alias("graph")).applyInPandas(fit, "id string, side string, v array<double>")


def _propagated(start: DataFrame, entries: DataFrame, layers: int, names: list[str]) -> DataFrame:
    """(``row``, a column per dimension): the mean of ``start`` over 0 to ``layers`` steps; rows may be missing from it, which count as zero.

    ``entries`` is (``to``, ``at``, ``w``, ``keeps``): the adjacency and, with ``keeps``, one entry per vertex that
    carries its sum on. A step is a join and an aggregation that combines before the shuffle.
    """
    state = start.select("row", *[F.col(c).alias(f"now_{c}") for c in names], *[F.col(c).alias(f"sum_{c}") for c in names])
    for _ in range(layers):
        met = state.join(entries, F.col("row") == F.col("at"))
        step = {c: F.sum(F.col(f"now_{c}") * F.col("w")) for c in names}
        kept = {c: F.sum(F.when(F.col("keeps"), F.col(f"sum_{c}")).otherwise(F.lit(0.0))) for c in names}
        state = met.groupBy("to").agg(*[step[c].alias(f"now_{c}") for c in names], *[(kept[c] + step[c]).alias(f"sum_{c}") for c in names]).withColumnRenamed("to", "row")
    return state.select("row", *[(F.col(f"sum_{c}") / (layers + 1)).alias(c) for c in names])


def train_sharded(pairs: DataFrame, all_vertices: DataFrame, user_prefix: str, options: TrainingOptions) -> tuple[DataFrame, list[float]]:
    """``train`` over tables: the embeddings (``id``, ``side``, ``v``) and the ranking loss of each step.

    The steps are those of ``train_arrays``; initial values are drawn from a hash of (seed, row, dimension). The driver
    draws each batch and holds the vectors of its vertices, at most three times ``batch_size``; the table of the
    vertices is written once per step.
    """
    o, spark = options, pairs.sparkSession
    vertices = materialize(row_index(all_vertices, user_prefix), "rows")
    sides = {r["side"]: r["count"] for r in vertices.groupBy("side").count().collect()}
    n_users, n_items = sides["user"], sides["item"]
    n = n_users + n_items
    row_of = lambda c: vertices.select(F.col("id").alias(c), F.col("row").alias(f"{c}_row"))
    edges = normalized_adjacency(pairs).join(row_of("row"), "row").join(row_of("col"), "col")
    moves = edges.select(F.col("row_row").alias("to"), F.col("col_row").alias("at"), "w", F.lit(False).alias("keeps"))
    entries = materialize(moves.unionByName(vertices.select(F.col("row").alias("to"), F.col("row").alias("at"), F.lit(0.0).alias("w"), F.lit(True).alias("keeps"))), "entries")
    placed = materialize(number_rows(pairs, ["user", "item"], "place", 0).join(row_of("user"), "user").join(row_of("item"), "item").select("place", "user_row", "item_row"), "pairs")
    n_pairs = placed.count()

    names = [f"x{d}" for d in range(o.embedding_dim)]
    bound = float(np.sqrt(6 / (n + o.embedding_dim)))
    start = [((draw(o.seed, F.col("row"), d) / float(2**32) * 2 - 1) * bound).alias(c) for d, c in enumerate(names)]
    zeros = [F.lit(0.0).alias(f"{kind}_{c}") for kind in ("first", "second") for c in names]
    table = materialize(vertices.select("row", *start, *zeros), "embeddings")

    rng = np.random.default_rng(o.seed)
    size, losses = min(o.batch_size, n_pairs), []
    for step in range(1, max(o.epochs, int(np.ceil(o.draws_per_pair * n_pairs / size))) + 1):
        picks = rng.integers(0, n_pairs, size)
        other = rng.integers(0, n_items, size) + n_users
        drawn = F.broadcast(spark.createDataFrame([(int(p),) for p in np.unique(picks)], "place long"))
        pair = {r["place"]: (r["user_row"], r["item_row"]) for r in placed.join(drawn, "place").collect()}
        users, liked = (np.array([pair[int(p)][k] for p in picks]) for k in (0, 1))
        rows = np.unique(np.concatenate([users, liked, other]))
        asked = F.broadcast(spark.createDataFrame([(int(r),) for r in rows], "row long"))
        found = {r[0]: r[1:] for r in _propagated(table, entries, o.layers, names).join(asked, "row").select("row", *names).collect()}
        at = lambda some: np.searchsorted(rows, some)
        loss, g = _batch_gradient(np.array([found[int(r)] for r in rows]), at(users), at(liked), at(other))
        losses.append(loss)
        schema = ", ".join(["row long", *[f"{c} double" for c in names]])
        moved = _propagated(spark.createDataFrame([(int(r), *map(float, x)) for r, x in zip(rows, g)], schema), entries, o.layers, names)
        both = table.join(moved.select("row", *[F.col(c).alias(f"g_{c}") for c in names]), "row", "left")
        slope = {c: F.coalesce(f"g_{c}", F.lit(0.0)) + 2 * o.regularization / (n * o.embedding_dim) * F.col(c) for c in names}
        first = {c: BETA_1 * F.col(f"first_{c}") + (1 - BETA_1) * slope[c] for c in names}
        second = {c: BETA_2 * F.col(f"second_{c}") + (1 - BETA_2) * slope[c] * slope[c] for c in names}
        new = {c: F.col(c) - o.learning_rate * (first[c] / (1 - BETA_1**step)) / (F.sqrt(second[c] / (1 - BETA_2**step)) + EPSILON) for c in names}
        table = materialize(both.select("row", *[v.alias(c) for c, v in new.items()], *[v.alias(f"first_{c}") for c, v in first.items()], *[v.alias(f"second_{c}") for c, v in second.items()]), "embeddings")
    out = _propagated(table, entries, o.layers, names).select("row", F.array(*names).alias("v"))
    return vertices.join(out, "row").select("id", "side", "v"), losses
