"""A named graph: inserts, lookups, recommendations and embeddings over one edge log."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable, Iterable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.operators import lightgcn, ranking, storage, training
from graphloom.operators.sequence import number_rows
from graphloom.runtime import remove, scratch
from graphloom.serving import MemoryStore, PeriodicPlugin, Store, Telemetry, monotonic_ms

LOG_SCHEMA = "seq bigint, ts bigint, src string, dst string, etype string, weight double"
MODEL_VERSION = 1


class Algorithm(Protocol):
    """Anything that ranks: called with the graph, the seeds (``id``), the kind of result asked for and options."""

    def __call__(self, graph: Graph, seeds: DataFrame, kind: str, **options: Any) -> DataFrame: ...


class EmbeddingsNotReady(RuntimeError):
    """No embeddings have been loaded."""


class InvalidEmbeddings(ValueError):
    """What was to be loaded isn't a stored model."""


def _accepted(fn: Callable, options: dict[str, Any]) -> dict[str, Any]:
    names = inspect.signature(fn).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in names.values()):
        names = [*names, "walk_length", "reset_prob", "mode", "num_walks", "random_seed", "weighted"]
    return {k: v for k, v in options.items() if k in names}


def _pagerank(graph: Graph, seeds: DataFrame, kind: str, **options: Any) -> DataFrame:
    return ranking.pagerank(graph.edges, seeds, **_accepted(ranking.pagerank, options))


def _salsa(graph: Graph, seeds: DataFrame, kind: str, **options: Any) -> DataFrame:
    return ranking.salsa(graph.edges, seeds, **_accepted(ranking.salsa, options))


def _similar(graph: Graph, seeds: DataFrame, kind: str, **options: Any) -> DataFrame:
    return ranking.similar_items(graph.edges, seeds, **_accepted(ranking.similar_items, options))


def _global(graph: Graph, seeds: DataFrame, kind: str, **options: Any) -> DataFrame:
    return ranking.global_rank(graph.edges, graph.vertices, **_accepted(ranking.global_rank, options))


def _lightgcn(graph: Graph, seeds: DataFrame, kind: str, top_k: int = 20, exclude_seen: bool = False, **_: Any) -> DataFrame:
    if graph.model is None:
        raise EmbeddingsNotReady("load_embeddings has not been called")
    users = graph.model.where(F.col("side") == "user").join(seeds.select("id").distinct(), "id", "left_semi")
    seen = None
    if exclude_seen:
        both = storage.both_ways(graph.edges.select("src", "dst"))
        seen = both.select(F.col("src").alias("user"), F.col("dst").alias("item")).join(seeds.select(F.col("id").alias("user")), "user", "left_semi").distinct()
    scored = lightgcn.score_top_k(users.select("id", "v"), graph.model.where(F.col("side") == "item").select("id", "v"), top_k, seen)
    return scored.select(F.col("user").alias("seed"), F.col("item").alias("id"), "score", "rank")


ALGORITHMS: dict[str, Algorithm] = {"pagerank": _pagerank, "salsa": _salsa, "similar_items": _similar, "global_rank": _global, "lightgcn": _lightgcn}

_instances: dict[str, Graph] = {}


def instance(name: str) -> Graph:
    """The open graph of this name."""
    if name not in _instances:
        raise LookupError(f"no graph named {name!r} is open")
    return _instances[name]


class Graph:
    """Open with a config, close when done (or use as a context manager).

    Inserts are an append-only log of Parquet folders by segment in the shared folder, so a plan over it is one scan
    however many inserts there were; single ones gather on the driver until something is read. Segments of
    ``segment_max_edges`` inserts follow from the sequence numbers. Pruning deletes the files of closed segments, while
    known vertices stay known.
    """

    def __init__(
        self, spark: SparkSession, config: Config, *, clock: Callable[[], int] = monotonic_ms, store: Store | None = None, telemetry: Telemetry | None = None
    ) -> None:
        if config.name in _instances:
            raise ValueError(f"a graph named {config.name!r} is open already")
        self.spark, self.config, self.clock = spark, config, clock
        self.telemetry = telemetry or Telemetry()
        self.store = store or MemoryStore(clock, lambda held: held.unpersist())
        self.model: DataFrame | None = None
        self.model_info: dict[str, Any] | None = None
        self._path, self._parts, self._prunings = scratch(spark, "graph"), 0, 0
        self._pending: list[tuple] = []
        self._inserted = 0
        self._started = clock()
        self.plugins: list[PeriodicPlugin] = [make(self) for make in config.plugins]
        if config.mode == "serving":
            for plugin in self.plugins:
                plugin.start()
        _instances[config.name] = self

    def close(self) -> None:
        for plugin in self.plugins:
            plugin.stop()
        self.store.clear()
        _instances.pop(self.config.name, None)

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # -- inserts

    def insert_edge(self, src: str, dst: str, etype: str, weight: float = 1.0) -> None:
        """Append one edge."""
        if src is None or dst is None:
            raise ValueError("an edge needs both ends")
        with self.telemetry.span("ingestion.insert_edge", graph=self.config.name):
            self._inserted += 1
            if self._inserted > 1 and (self._inserted - 1) % self.config.segment_max_edges == 0:
                with self.telemetry.span("graph.create_segment", graph=self.config.name, segment=(self._inserted - 1) // self.config.segment_max_edges):
                    pass
            self._pending.append((self._inserted, self.clock(), str(src), str(dst), str(etype), float(weight)))

    def insert_edges(self, df: DataFrame, order: Iterable[str]) -> int:
        """Append an edge log (``src``, ``dst``, ``etype``, ``weight`` and the columns of ``order``) in that order; how many edges it has.

        Rows without both ends are no edges; a null weight is 1.0.
        """
        self._drain()
        df = df.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        with self.telemetry.span("ingestion.insert_edges", graph=self.config.name) as meta:
            numbered = number_rows(df, list(order), "seq", self._inserted + 1)
            rows = numbered.select("seq", F.lit(self.clock()).cast("bigint").alias("ts"), "src", "dst", "etype", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
            added = self._append(rows)
            self._inserted += added
            meta["count"] = added
            return added

    def _append(self, rows: DataFrame) -> int:
        part = f"{self._path}/log/part={self._parts}"
        storage.assign_segments(rows, self.config.segment_max_edges).write.partitionBy("segment_id").parquet(part)
        self._parts += 1
        return self.spark.read.schema(f"{LOG_SCHEMA}, segment_id bigint").parquet(part).count()

    def _drain(self) -> None:
        if self._pending:
            rows, self._pending = self._pending, []
            self._append(self.spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1))

    @property
    def log(self) -> DataFrame:
        """All inserts of live segments, with their segments."""
        self._drain()
        schema = f"{LOG_SCHEMA}, segment_id bigint"
        if not self._parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self._path}/log").drop("part")

    # -- lookups

    @property
    def edges(self) -> DataFrame:
        """The stored edges of all live segments."""
        return storage.stored_edges(self.log)

    @property
    def vertices(self) -> DataFrame:
        """(``id``): every end that was ever inserted."""
        found = storage.vertices(self.log)
        return found.unionByName(self.spark.read.schema("id string").parquet(f"{self._path}/known").select("id")).distinct() if self._prunings else found

    @property
    def segments(self) -> DataFrame:
        """Live segments; the first was created when the graph was opened."""
        meta = storage.segment_meta(self.log)
        return meta.withColumn("created_at", F.when(F.col("segment_id") == 0, F.lit(self._started)).otherwise(F.col("created_at")))

    def neighbors(self, vertex: str, direction: str = "outgoing", etype: str | None = None) -> DataFrame:
        """(``neighbour``): the distinct other ends; none for an unknown vertex."""
        here = "src" if direction == "outgoing" else "dst"
        return storage.neighbours(self.edges.where(F.col(here) == vertex), None, direction, etype).select("neighbour")

    def edge_count(self) -> int:
        """Inserts into live segments, repeated ones included."""
        return self.log.count()

    def vertex_count(self) -> int:
        """Vertices ever seen."""
        return self.vertices.count()

    def prune(self, cutoff: int) -> int:
        """Drop closed segments created before ``cutoff`` (the clock's ms); how many that were."""
        gone = [r["segment_id"] for r in storage.expired_segments(self.segments, F.lit(cutoff)).select("segment_id").collect()]
        if gone:
            # a row per vertex stays of what is deleted
            storage.vertices(self.log.where(F.col("segment_id").isin(gone))).write.parquet(f"{self._path}/known/pruning={self._prunings}")
            self._prunings += 1
            for segment in gone:
                remove(self.spark, f"{self._path}/log/part=*/segment_id={segment}")
        return len(gone)

    def prune_expired(self) -> int:
        return self.prune(self.clock() - self.config.segment_ttl)

    # -- recommendations

    def _seeds(self, entities: str | Iterable[str] | DataFrame) -> tuple[DataFrame, tuple[str, ...] | None]:
        if isinstance(entities, DataFrame):
            return entities.select("id"), None
        ids = (entities,) if isinstance(entities, str) else tuple(sorted(set(entities)))
        return self.spark.createDataFrame([(i,) for i in ids], "id string"), ids

    def _resolve(self, algorithm: str | Algorithm) -> Algorithm:
        found = ALGORITHMS.get(algorithm) if isinstance(algorithm, str) else algorithm
        if not callable(found):
            raise ValueError(f"unknown algorithm: {algorithm!r}")
        return found

    def recommend(self, entities: str | Iterable[str] | DataFrame, kind: str = "content", algorithm: str | Algorithm = "pagerank", **options: Any) -> DataFrame:
        """Rankings for one vertex or many; unknown ones have none.

        While no embeddings are loaded, ``lightgcn`` falls back to ``salsa`` with the same options. In serving mode
        results for named vertices are kept for ``result_ttl``, by all options (or, with ``cache_key="compat"``, by
        vertex, kind and algorithm alone); what a fallback gave isn't kept.
        """
        with self.telemetry.span("query.recommend", graph=self.config.name, kind=kind):
            seeds, ids = self._seeds(entities)
            key: tuple | None = None
            if self.config.mode == "serving" and ids is not None:
                key = (ids, kind, algorithm) if self.config.cache_key == "compat" else (ids, kind, algorithm, tuple(sorted((k, repr(v)) for k, v in options.items())))
                hit, held = self.store.get(key)
                if hit:
                    return held
            compute = self._resolve(algorithm)
            try:
                result = compute(self, seeds, kind, **options)
            except EmbeddingsNotReady:
                return _salsa(self, seeds, kind, **options)
            if key is not None:
                result = result.persist()
                try:
                    result.count()  # what can't be computed isn't kept
                except Exception:
                    result.unpersist()
                    raise
                self.store.put(key, result, self.config.result_ttl)
            return result

    def similar(self, entities: str | Iterable[str] | DataFrame, **options: Any) -> DataFrame:
        """``recommend`` by shared sources."""
        return self.recommend(entities, algorithm="similar_items", **options)

    def circle_of_trust(self, entities: str | Iterable[str] | DataFrame, size: int = 100, **walk: Any) -> DataFrame:
        """(``seed``, ``id``): the vertices each of the given ones visits most."""
        return ranking.circle_of_trust(self.edges, self._seeds(entities)[0], size, **walk)

    # -- embeddings

    def train_embeddings(self, path: str, user_prefix: str, **options: Any) -> dict[str, Any]:
        """Train on the live edges and write the model to ``path``; its description. Doesn't load it."""
        o = training.TrainingOptions(**options)
        vectors = training.train(self.edges, self.vertices, user_prefix, o)
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        sides = {r["side"]: r["count"] for r in self.spark.read.parquet(f"{path}/vectors").groupBy("side").count().collect()}
        info = {"version": MODEL_VERSION, "user_count": sides.get("user", 0), "item_count": sides.get("item", 0), "embedding_dim": o.embedding_dim, "trained_at": int(time.time())}
        self.spark.createDataFrame([(json.dumps(info),)], "info string").write.mode("overwrite").parquet(f"{path}/info")
        return info

    def load_embeddings(self, path: str) -> None:
        """Replace the current model; cached results of the old one are dropped. Ids are external, so any graph may load it."""
        try:
            vectors = self.spark.read.parquet(f"{path}/vectors")
            info = json.loads(self.spark.read.parquet(f"{path}/info").first()["info"])
        except Exception as error:
            raise InvalidEmbeddings(f"no model at {path}") from error
        kinds = dict(vectors.dtypes)
        if kinds.get("id") != "string" or kinds.get("side") != "string" or kinds.get("v") not in ("array<double>", "array<float>"):
            raise InvalidEmbeddings("vectors need id, side and v")
        if not all(isinstance(info.get(k), int) for k in ("version", "user_count", "item_count", "trained_at")):
            raise InvalidEmbeddings("the description is incomplete")
        self.model, self.model_info = vectors, info
        self.store.clear()

    @property
    def embeddings_ready(self) -> bool:
        return self.model is not None
