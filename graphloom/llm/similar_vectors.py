"""The most similar vectors of every vector, by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted files of the first of them; those
who meet in a file are ranked by the footrule distance of their permutations, and the better part is reranked by the
true cosine. Every vector is indexed; only the pivots are a bounded sample.

What is reranked is a share of what meets, and the files a vector is posted in grow with the logarithm of the number of
vectors, so that recall doesn't fall as the collection grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.runtime import materialize

#: Pivots are PIVOTS_PER_ROOT times the square root of the number of vectors, within these bounds. The upper one, which
#: bounds what is broadcast, is reached at a thousand million vectors; beyond it files grow in proportion to them.
PIVOTS_PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 2.0, 32, 65_535
#: Pivots in a permutation.
PERMUTATION = 22
#: A vector is posted under POSTED pivots at least, and under POSTED_PER_TENFOLD more for every tenfold of vectors above POSTED_FROM.
POSTED, POSTED_PER_TENFOLD, POSTED_FROM = 8, 4, 25_000
#: The share of the entries of a file, best by footrule distance, that are reranked for each vector; at least RERANKED_LEAST.
RERANKED, RERANKED_LEAST = 0.6, 64
#: Vectors of a file that one task compares with as many others.
BLOCK = 16_384
#: Of these, entries that are looked up at once, and comparisons made at once.
CHUNK, AT_ONCE = 2_048, 32_768
#: Classes of copies with at least this many members, and this share of all vectors, have their class broadcast.
HOT_CLASS, HOT_SHARE = 1_000, 0.001


def usable_vectors(df: DataFrame, item: str, vector: str, dim: int) -> DataFrame:
    """(``item``, ``v``) of the rows whose vector has ``dim`` finite numbers, not all zero.

    ``v`` is an array of floats, where the vector is one, else of doubles. Null items and vectors, other lengths, null
    or non-finite entries and zero vectors are left out.
    """
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(item).alias("item"), F.col(vector).cast(kind).alias("v"))
    # comparisons with null and NaN (the greatest number) don't hold
    sound = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return rows.where(F.col("item").isNotNull() & (F.size("v") == dim) & sound & F.exists("v", lambda x: x != 0))


def files_of(n: int) -> int:
    """The number of files each of ``n`` vectors is posted in."""
    return max(POSTED, round(POSTED + POSTED_PER_TENFOLD * math.log10(max(n, 1) / POSTED_FROM)))


def sample_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of a sample of rows, the same for the same rows; at most MAX_PIVOTS come to the driver."""
    k = min(n, MAX_PIVOTS, max(MIN_PIVOTS, int(PIVOTS_PER_ROOT * math.sqrt(n))))
    rows = vectors.orderBy(F.xxhash64("item"), "item").limit(k).select("v").toArrow()
    pivots = rows.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(k, -1).astype(np.float64)
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True)


def permutations(vectors: DataFrame, pivots: np.ndarray, length: int = PERMUTATION, posted: int = POSTED) -> DataFrame:
    """The index of ``vectors``: ``item``, ``code BINARY`` (the vector's numbers, then its nearest pivots in order) and ``files ARRAY<INT>``, the first of these."""
    length = min(length, len(pivots))
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([vectors.schema["item"], T.StructField("code", T.BinaryType()), T.StructField("files", T.ArrayType(T.IntegerType()))])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            v = raw.astype(np.float64)
            near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ p.T
            first = np.argpartition(-near, length - 1, axis=1)[:, :length]
            by = np.take_along_axis(near, first, 1)
            # equally near pivots in the order of their numbers
            perm = np.take_along_axis(first, np.lexsort((first, -by), axis=1), 1)
            codes = np.hstack([np.ascontiguousarray(raw).view(np.uint8), np.ascontiguousarray(perm.astype(np.uint16)).view(np.uint8)])
            files = pa.array(list(perm[:, :posted].astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), files], names=["item", "code", "files"])

    return vectors.select("item", "v").mapInArrow(order, schema)


def _best_of(q_ids: np.ndarray, q_vectors: np.ndarray, q_perm: np.ndarray, ids: np.ndarray, vectors: np.ndarray, perm: np.ndarray, k: int, share: float) -> list[np.ndarray]:
    """Of some entries of a file: the ``k`` best of each query, as its place, the entry's id and the rounded cosine."""
    n, m = perm.shape
    pivots, local = np.unique(perm, return_inverse=True)
    local = local.reshape(perm.shape)
    small = np.uint8 if m * (m + 1) // 2 < 256 else np.uint16
    # nearness[p, x]: m for the first pivot of x, down to 1 for its last, 0 if p isn't in its permutation
    nearness = np.zeros((len(pivots) + 1, n), small)
    for j in range(m):
        nearness[local[:, j], np.arange(n)] = m - j
    spot = np.minimum(np.searchsorted(pivots, q_perm), len(pivots) - 1)
    spot = np.where(pivots[spot] == q_perm, spot, len(pivots))
    reranked, take = min(n, max(RERANKED_LEAST, math.ceil(share * n))), min(k, n)
    # where a query stands among the entries itself
    order = np.argsort(ids)
    own = order[np.minimum(np.searchsorted(ids, q_ids, sorter=order), n - 1)]
    is_own = ids[own] == q_ids
    out: list[list[np.ndarray]] = [[], [], []]
    step = max(1, AT_ONCE // n)
    near, lesser = np.empty((step, n), small), np.empty((step, n), small)
    # arrays, since the least of an array and a number is found one by one
    most = [np.full((step, n), m - j, small) for j in range(m)]
    for at in range(0, len(q_ids), step):
        part = slice(at, min(at + step, len(q_ids)))
        now, held = near[: part.stop - at], lesser[: part.stop - at]
        # footrule distance = m (m + 1) - 2 * the sum over shared pivots of the lesser nearness
        nearness.take(spot[part, 0], axis=0, out=now, mode="clip")
        for j in range(1, m):
            nearness.take(spot[part, j], axis=0, out=held, mode="clip")
            np.minimum(held, most[j][: part.stop - at], out=held)
            np.add(now, held, out=now)
        cosine = q_vectors[part] @ vectors.T
        # what is as near as the last of the reranked is reranked as well
        least = np.partition(now.astype(np.float32), n - reranked, axis=1)[:, n - reranked, None].astype(small)
        np.putmask(cosine, now < least, -2)
        mine = np.nonzero(is_own[part])[0]
        cosine[mine, own[part][mine]] = -2
        # equal when rounded may stand on both sides of the last: a little more than k goes on to be rounded and ordered
        last = np.partition(cosine, n - take, axis=1)[:, n - take, None]
        row, col = np.divmod(np.flatnonzero(cosine >= np.maximum(last - 2e-6, -1.5)), n)
        for kept, values in zip(out, (row + at, ids[col], np.round(cosine[row, col], 6))):
            kept.append(values)
    return _first(*(np.concatenate(x) for x in out), k)


def _first(row: np.ndarray, ids: np.ndarray, cosine: np.ndarray, k: int) -> list[np.ndarray]:
    """The ``k`` best of each row, by cosine, then id."""
    order = np.lexsort((ids, -cosine, row))
    row, ids, cosine = row[order], ids[order], cosine[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return [x[place < k] for x in (row, ids, cosine)]


def _rank_tile(k: int, share: float, dim: int, number: str):
    """Ranks the entries of one tile of an inverted file for each of its queries."""

    def rank(tile: pa.Table) -> pa.Table:
        asks, answers = (tile.column(c).to_numpy().astype(bool) for c in ("asks", "answers"))
        names, ids = np.unique(tile.column("item").to_numpy(), return_inverse=True)
        code = np.frombuffer(b"".join(tile.column("code").to_pylist()), np.uint8).reshape(tile.num_rows, -1)
        width = dim * np.dtype(number).itemsize
        vectors = np.ascontiguousarray(code[:, :width]).view(number).astype(np.float64)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        perm = np.ascontiguousarray(code[:, width:]).view(np.uint16)
        q, x = np.nonzero(asks)[0], np.nonzero(answers)[0]
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for at in range(0, len(x) if len(q) else 0, CHUNK):
            part = x[at : at + CHUNK]
            more = _best_of(ids[q], vectors[q], perm[q], ids[part], vectors[part], perm[part], k, share)
            found = _first(*(np.concatenate(both) for both in zip(found, more)), k)
        kind = tile.schema.field("item").type
        columns = [pa.array(names[ids[q][found[0]]], kind), pa.array(names[found[1]], kind), pa.array(found[2])]
        return pa.Table.from_arrays(columns, names=["a", "b", "cosine"])

    return rank


def _neighbours(indexed: DataFrame, k: int, reranked: float, block: int, queries: DataFrame | None, dim: int, number: str) -> DataFrame:
    """(``a``, ``b``, ``cosine``, ``rank``): the ``k`` best of each vector among all it meets in its files."""
    asks = F.lit(True)
    posts = indexed
    if queries is not None:
        posts = posts.join(queries.select(F.col("item").alias("asked")), F.col("item") == F.col("asked"), "left")
        asks = F.col("asked").isNotNull()
    posts = posts.select("item", "code", asks.alias("asks"), F.explode("files").alias("file"))
    # one count per pivot: at most MAX_PIVOTS rows
    lengths = F.broadcast(
        indexed.select(F.explode("files").alias("file")).groupBy("file").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    )
    cut = posts.join(lengths, "file").withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # a long file is cut into blocks and every pair of blocks is a tile: a vector asks in one row, answers in one column
    here = F.col("block")
    as_query = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(here.alias("row"), o.alias("col")))
    as_entry = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(o.alias("row"), here.alias("col")))
    tiles = F.when(F.col("asks"), F.array_union(as_query, as_entry)).otherwise(as_entry)
    tiled = cut.select("item", "code", "asks", "file", "block", F.explode(tiles).alias("t")).select(
        "item", "code", "file", F.col("t.row").alias("row"), F.col("t.col").alias("col"),
        (F.col("asks") & (F.col("block") == F.col("t.row"))).alias("asks"), (F.col("block") == F.col("t.col")).alias("answers"),
    )
    kind = dict(indexed.dtypes)["item"]
    ranked = tiled.groupBy("file", "row", "col").applyInArrow(_rank_tile(k, reranked, dim, number), f"a {kind}, b {kind}, cosine double")
    order = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    return ranked.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _members(usable: DataFrame, copies: DataFrame, n: int) -> DataFrame:
    """(``class``, ``item``) of the classes ``copies`` (``v``, ``item``, ``size``): large ones, of which there are few, meet their rows by broadcast."""
    large = F.col("size") >= max(HOT_CLASS, HOT_SHARE * n)
    named = copies.select("v", F.col("item").alias("class"), large.alias("large"))
    parts = [usable.join(F.broadcast(named.where("large")), "v"), usable.join(named.where("NOT large"), "v")]
    return parts[0].unionByName(parts[1]).select("class", "item")


def most_similar(
    df: DataFrame, item: str, vector: str, dim: int, k: int = 5, queries: DataFrame | None = None, posted: int | None = None, reranked: float = RERANKED, block: int = BLOCK
) -> DataFrame:
    """The ``k`` items most similar to each item: ``item_a``, ``item_b``, ``cosine`` (rounded to 6 decimals), ``rank``.

    Order: cosine descending, then ``item_b``; the item itself is no neighbour. ``item`` must be unique. ``queries``
    (a column ``item``) restricts who asks, never who answers. Items with exactly the same vector are indexed once and
    stand in each result by their lowest ids, so copies, however many, cost one entry and lose nothing. Unusable
    vectors (see ``usable_vectors``) neither ask nor answer; an empty table gives an empty result.

    The index is approximate: a neighbour that shares no file with an item, or is in the worse part (beyond the share
    ``reranked``) of all files they share, is missed. ``posted`` files of a vector default to ``files_of``.
    """
    usable = usable_vectors(df, item, vector, dim)
    # copies share a class, named by its lowest item; a class needs k + 1 members at most to answer
    classes = materialize(usable.groupBy("v").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("size")), "vector-classes")
    told = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("size") > 1, 1))).first()
    n, n_items, n_copied = told[0], told[1], told[2]
    kind = dict(usable.dtypes)["item"]
    if n == 0:
        return df.sparkSession.createDataFrame([], f"item_a {kind}, item_b {kind}, cosine double, rank int")
    files = posted or files_of(n)
    number = "float32" if dict(usable.dtypes)["v"] == "array<float>" else "float64"
    indexed = materialize(permutations(classes, sample_pivots(classes, n), max(PERMUTATION, files), files), "permutation-index")
    asking, asked_items = None, None
    if queries is not None:
        asked_items = queries.select(F.col("item").alias("asked")).distinct()
        asked = usable.join(asked_items, F.col("item") == F.col("asked"), "left_semi")
        asking = asked.join(classes.select("v", F.col("item").alias("class")), "v").select(F.col("class").alias("item")).distinct()
    near = _neighbours(indexed, k, reranked, block, asking, dim, number)
    if not n_copied:  # every class is one item
        return near.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "cosine", "rank")
    near = near.drop("rank")
    copies = classes.where(F.col("size") > 1)
    members = materialize(_members(usable, copies, n_items), "class-members")
    by_class = Window.partitionBy("class").orderBy("item")
    lowest = members.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1).select("class", "item")
    # answers: every class by its lowest members, the asking class too (its other members have cosine 1)
    named = F.coalesce(F.col("item"), F.col("b"))
    answers = near.join(lowest, F.col("b") == F.col("class"), "left").select("a", named.alias("b"), "cosine")
    own = lowest.select(F.col("class").alias("a"), F.col("item").alias("b"), F.lit(1.0).alias("cosine"))
    first = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    lists = answers.unionByName(own).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("a", "b", "cosine")
    # askers: single items as they are; members of a class by its list, spread by as many salts as its size asks for
    single = lists.join(copies.select("item"), F.col("a") == F.col("item"), "left_anti")
    salts = copies.select(F.col("item").alias("class"), F.ceil(F.col("size") / F.lit(HOT_CLASS)).cast("int").alias("salts"))
    salted = members.join(salts, "class").select(F.col("item").alias("member"), "class", F.pmod(F.xxhash64("item"), F.col("salts")).cast("int").alias("salt"))
    spread = lists.join(salts, F.col("a") == F.col("class")).select("a", "b", "cosine", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    copied = spread.join(salted, (F.col("a") == F.col("class")) & (F.col("s") == F.col("salt"))).select(F.col("member").alias("a"), "b", "cosine")
    every = single.unionByName(copied).where(F.col("a") != F.col("b"))
    if asked_items is not None:
        every = every.join(asked_items, F.col("a") == F.col("asked"), "left_semi")
    ranked = every.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "cosine", "rank")


def exact_neighbours(df: DataFrame, item: str, vector: str, dim: int, k: int, queries: DataFrame, block: int = 2_048) -> DataFrame:
    """The true ``k`` neighbours of the items in ``queries`` (a column ``item``): all vectors in blocks against them.

    The columns are those of ``most_similar``. Queries are cut into groups of ``block``; each is compared with the
    blocks of all vectors, and only the best ``k`` of a pair of blocks go on.
    """
    usable = usable_vectors(df, item, vector, dim).withColumn("v", F.col("v").cast("array<double>"))
    asked = usable.join(queries.select(F.col("item").alias("asked")).distinct(), F.col("item") == F.col("asked"), "left_semi")
    q_parts, x_parts = max(1, -(-asked.count() // block)), max(1, -(-usable.count() // block))
    part = lambda n: F.pmod(F.xxhash64("item"), F.lit(n)).cast("int")
    q = asked.withColumn("row", part(q_parts)).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(x_parts - 1)))).withColumn("asks", F.lit(True))
    x = usable.withColumn("col", part(x_parts)).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))).withColumn("asks", F.lit(False))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("item", kind="stable")
        a, b = tile[tile["asks"]], tile[~tile["asks"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": tile["item"][:0], "b": tile["item"][:0], "cosine": np.zeros(0)})
        va, vb = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        va, vb = va / np.linalg.norm(va, axis=1, keepdims=True), vb / np.linalg.norm(vb, axis=1, keepdims=True)
        ia, ib = a["item"].to_numpy(), b["item"].to_numpy()
        cosine = np.round(va @ vb.T, 6)
        cosine[ia[:, None] == ib[None, :]] = -2
        top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(cosine, top, 1).ravel()
        keep = found > -2
        return pd.DataFrame({"a": np.repeat(ia, top.shape[1])[keep], "b": ib[top].ravel()[keep], "cosine": found[keep]})

    kind = dict(usable.dtypes)["item"]
    columns = ["item", "v", "row", "col", "asks"]
    best = q.select(*columns).unionByName(x.select(*columns)).groupBy("row", "col").applyInPandas(compare, f"a {kind}, b {kind}, cosine double")
    order = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "cosine", "rank")
