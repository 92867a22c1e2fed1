"""Storage, rankers and embeddings against hand-computed values."""

from __future__ import annotations

import hashlib
import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.config import Config
from graphloom.graph import EmbeddingsNotReady, Graph, InvalidEmbeddings, instance
from graphloom.operators import evaluation, lightgcn, ranking, storage, training
from graphloom.operators.sequence import number_rows
from graphloom.serving import CacheCleaner, MemoryStore, PeriodicPlugin, Pruner, Telemetry
from tests.conftest import rows


class Clock:
    def __init__(self):
        self.now = 0

    def __call__(self):
        return self.now


def edges_of(spark, text, etype="x"):
    data = [(a, b, etype, 1.0) for a, b in (e.split(">") for e in text.split())]
    return spark.createDataFrame(data, "src string, dst string, etype string, weight double")


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


@pytest.fixture
def graph(spark):
    clock = Clock()
    with Graph(spark, Config("g", "bipartite", segment_max_edges=3, mode="batch"), clock=clock) as g:
        yield g


# -- config


@pytest.mark.parametrize(
    "bad",
    [{"graph_type": "tree"}, {"mode": "x"}, {"segment_max_edges": 0}, {"segment_max_edges": -1}, {"segment_ttl": 0}, {"result_ttl": -1}, {"name": ""}, {"cache_key": "x"}],
)
def test_config_is_validated(bad):
    with pytest.raises(ValueError):
        Config(**({"name": "a", "graph_type": "directed"} | bad))


def test_config_needs_name_and_type():
    with pytest.raises(TypeError):
        Config(name="a")


# -- storage


def test_segments_rotate_and_prune(graph):
    for k in range(4):
        graph.clock.now = k
        graph.insert_edge(str(k), str(k + 1), "x")
    assert graph.segments.count() == 2 and graph.edge_count() == 4 and graph.vertex_count() == 5
    assert graph.prune(10**6) == 1
    assert graph.edge_count() == 1 and graph.vertex_count() == 5
    assert rows(graph.neighbors("0")) == [] and rows(graph.neighbors("3")) == [("4",)]
    assert graph.prune(10**6) == 0


def test_pruned_segments_leave_no_files(graph, spark):
    for k in range(7):
        graph.insert_edge(str(k), str(k + 1), "x")
    path = graph._path.removeprefix("file://")
    folders = lambda: sorted(f.name for f in Path(path).glob("log/part=*/segment_id=*"))
    assert graph.edge_count() == 7 and folders() == ["segment_id=0", "segment_id=1", "segment_id=2"]
    graph.clock.now = 5
    assert graph.prune(5) == 2 and folders() == ["segment_id=2"]
    assert graph.edge_count() == 1 and graph.vertex_count() == 8


def test_batches_without_both_ends_and_plans_that_do_not_grow(graph, spark):
    batch = spark.createDataFrame([("a", "b", "x", 2.0), (None, "b", "x", 1.0), ("a", None, "x", 1.0), ("b", "c", None, None)], "src string, dst string, etype string, weight double")
    assert graph.insert_edges(batch, ["src"]) == 2
    assert rows(graph.edges, "src", "dst", "weight") == [("a", "b", 2.0), ("b", "c", 1.0)] and graph.vertex_count() == 3
    before = str(graph.log._jdf.queryExecution().logical()).count("\n")
    for _ in range(3):
        assert graph.insert_edges(batch, ["src"]) == 2
    assert graph.edge_count() == 8 and str(graph.log._jdf.queryExecution().logical()).count("\n") == before
    assert graph.insert_edges(batch.limit(0), ["src"]) == 0


@pytest.mark.parametrize("size, stored, weight", [(100, 1, 1.0), (1, 2, 2.0)])
def test_repeated_rows_are_stored_once_per_segment(spark, size, stored, weight):
    with Graph(spark, Config("dup", "bipartite", segment_max_edges=size, mode="batch")) as g:
        g.insert_edge("user:u", "item:i", "like")
        g.insert_edge("user:u", "item:i", "like")
        assert g.edge_count() == 2 and g.edges.count() == stored
        assert rows(lightgcn.weighted_pairs(g.edges, "user:")) == [("user:u", "item:i", weight)]


def test_neighbors(graph):
    for a, b, t in (("u", "i", "like"), ("u", "i", "view"), ("u", "j", "view"), ("w", "i", "like")):
        graph.insert_edge(a, b, t)
    assert rows(graph.neighbors("u")) == [("i",), ("j",)]
    assert rows(graph.neighbors("u", etype="like")) == [("i",)]
    assert rows(graph.neighbors("i", "incoming")) == [("u",), ("w",)]
    assert rows(graph.neighbors("?")) == []
    with pytest.raises(ValueError):
        graph.neighbors("u", "sideways")


def test_graphs_are_isolated(spark):
    with Graph(spark, Config("one", "directed", mode="batch")) as a, Graph(spark, Config("two", "directed", mode="batch")) as b:
        a.insert_edge("x", "y", "t")
        assert b.edge_count() == 0 and instance("one") is a
        with pytest.raises(ValueError):
            Graph(spark, Config("one", "directed"))
    with pytest.raises(LookupError):
        instance("one")


def test_dictionary_is_in_order_of_appearance(spark):
    log = edges_of(spark, "b>c a>b c>d").withColumn("seq", F.monotonically_increasing_id())
    log = number_rows(log.withColumn("k", F.when(F.col("src") == "b", 1).when(F.col("src") == "a", 2).otherwise(3)), ["k"])
    assert rows(storage.vertex_dictionary(log), "internal_id", "id") == [(0, "b"), (1, "c"), (2, "a"), (3, "d")]


def test_numbers_are_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.pmod(F.col("id") * 37, F.lit(1000)))
    got = rows(number_rows(df, ["k"], "n", 5), "k", "n")
    assert got == [(k, k + 5) for k in range(1000)]


# -- rankers


def test_global_rank(spark):
    e = edges_of(spark, "p:1>A p:1>B p:2>A p:2>C p:3>A p:3>B p:3>C p:4>A p:5>D")
    v = storage.vertices(e)
    assert scores(ranking.global_rank(e, v)) == {"A": 1.0, "B": 0.5, "C": 0.5, "D": 0.25}
    assert set(scores(ranking.global_rank(e, v, min_degree=2))) == {"A", "B", "C"}
    assert set(scores(ranking.global_rank(e, v, prefix="q:"))) == set()
    assert scores(ranking.global_rank(e, v, prefix="p:", min_degree=0))["p:1"] == 0.0
    assert [r["id"] for r in ranking.global_rank(e, v, top_k=2).orderBy("rank").collect()] == ["A", "B"]


@pytest.mark.parametrize(
    "normalize, degree, expected",
    [("jaccard", "overlap", 0.333333), ("cosine", "overlap", 0.577350), ("jaccard", "global", 0.25), ("cosine", "global", 0.408248), ("raw", "overlap", 1.0)],
)
def test_similar_items(spark, normalize, degree, expected):
    e = edges_of(spark, "1>A 1>B 2>A 2>C 3>B 3>C 3>D 4>A 5>D")
    got = scores(ranking.similar_items(e, seed(spark, "A"), normalize, degree))
    assert set(got) == {"B", "C"} and all(abs(s - expected) < 1e-6 for s in got.values())
    assert scores(ranking.similar_items(e, seed(spark, "A"), normalize, degree, min_overlap=2)) == {}


def test_similar_items_of_hubs_are_cut_into_blocks(spark):
    rng = random.Random(4)
    text = " ".join(f"u{rng.randrange(3) if rng.random() < 0.7 else rng.randrange(30)}>i{rng.randrange(25)}" for _ in range(300))
    whole = rows(ranking.similar_items(edges_of(spark, text), None, "cosine", "global"))
    assert rows(ranking.similar_items(edges_of(spark, text), None, "cosine", "global", hub_targets=3)) == whole


def test_small_visits_are_not_dropped(spark):
    """Behind a vertex of very many edges a visit is rare, not absent."""
    hub = spark.range(3).select(F.lit("a").alias("src"), F.concat(F.lit("x"), F.col("id")).alias("dst"), F.lit("t").alias("etype"), F.when(F.col("id") == 0, 1e-12).otherwise(1.0).alias("weight"))
    assert {r["id"] for r in ranking.pagerank(hub, seed(spark, "a"), weighted=True).collect()} == {"x0", "x1", "x2"}


def test_pagerank_exact(spark):
    diamond = edges_of(spark, "A>B A>C B>D C>D D>A")
    v = {r["id"]: r["visits"] for r in ranking.expected_visits(diamond, seed(spark, "A"), 8).collect()}
    assert {k: round(x, 6) for k, x in v.items()} == {"A": 3.466322, "B": 1.346243, "C": 1.346243, "D": 1.841192}
    got = scores(ranking.pagerank(diamond, seed(spark, "A")))
    assert {k: round(x, 6) for k, x in got.items()} == {"D": 0.439011, "B": 0.280494, "C": 0.280494}
    leaf = scores(ranking.pagerank(edges_of(spark, "A>B B>C C>A A>D"), seed(spark, "A")))
    assert {k: round(x, 6) for k, x in leaf.items()} == {"B": 0.362221, "D": 0.362221, "C": 0.275558}
    ring = scores(ranking.pagerank(edges_of(spark, "A>B B>C C>A"), seed(spark, "A")))
    assert {k: round(x, 6) for k, x in ring.items()} == {"B": 0.560989, "C": 0.439011}


def test_pagerank_without_a_way_out_or_unknown_is_empty(spark):
    e = edges_of(spark, "A>B")
    assert ranking.pagerank(e, seed(spark, "B", "?")).count() == 0


def test_simulated_walks_agree_with_expectation(spark):
    e = edges_of(spark, "A>B A>C B>D C>D D>A")
    counted = {r["id"]: r["visits"] for r in ranking.simulated_visits(e, seed(spark, "A"), 4000, 8).collect()}
    assert sum(counted.values()) == 4000 * 8
    assert abs(counted["A"] / 4000 - 3.466322) < 0.05
    assert ranking.simulated_visits(e, seed(spark, "A"), 50, 4).collect() == ranking.simulated_visits(e, seed(spark, "A"), 50, 4).collect()
    with pytest.raises(ValueError):
        ranking.simulated_visits(e, seed(spark, "A"), 0)


def test_weighted_steps(spark):
    e = edges_of(spark, "A>B A>C A>D E>A").withColumn("weight", F.when(F.col("dst") == "B", 3.0).when(F.col("dst") == "C", 1.0).otherwise(0.0))
    v = {r["id"]: r["visits"] for r in ranking.expected_visits(e, seed(spark, "A", "E"), 2, 0.0, weighted=True).where("seed = 'A'").collect()}
    assert v == {"A": 1.0, "B": 0.75, "C": 0.25}
    lost = {r["id"]: r["visits"] for r in ranking.expected_visits(e, seed(spark, "E"), 3, 0.0, weighted=True).collect()}
    assert lost == {"E": 3.0}


def test_long_walks_are_cut(spark):
    v = {r["id"]: r["visits"] for r in ranking.expected_visits(edges_of(spark, "A>B B>A"), seed(spark, "A"), 23, 0.0).collect()}
    assert v == {"A": 12.0, "B": 11.0}
    counted = {r["id"]: r["visits"] for r in ranking.simulated_visits(edges_of(spark, "A>B B>A"), seed(spark, "A"), 2, 12, 0.0).collect()}
    assert counted == {"A": 12.0, "B": 12.0}


SALSA = "u1>a u1>b u2>a u2>c u3>b u3>c u3>d"


def test_salsa(spark):
    one = edges_of(spark, SALSA)
    two = storage.both_ways(one)
    assert ranking.salsa(one, seed(spark, "u1")).count() == 0
    for size, expected in ((2, {"u1": 0.5, "u2": 0.25, "u3": 0.25}), (3, {"u1": 1 / 3, "u2": 1 / 6, "c": 1 / 9, "d": 1 / 9}), (10, {"u1": 1 / 6})):
        for iterations in (1, 5):
            got = scores(ranking.salsa(two, seed(spark, "u1"), seed_size=size, iterations=iterations))
            assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in expected.items()}
    assert "u1" not in scores(ranking.salsa(two, seed(spark, "u1"), seed_size=2, exclude_self=True))
    assert abs(sum(scores(ranking.salsa(two, seed(spark, "u1"), seed_size=2, feedback=True)).values()) - 1) < 1e-9


# -- embeddings


def test_adjacency(spark):
    e = edges_of(spark, "p1>a p1>b p2>a")
    adj = {(r["row"], r["col"]): round(r["w"], 6) for r in lightgcn.normalized_adjacency(lightgcn.weighted_pairs(e, "p")).collect()}
    assert adj[("p1", "a")] == adj[("a", "p1")] == 0.5 and adj[("p1", "b")] == adj[("p2", "a")] == 0.707107 and len(adj) == 6
    heavy = e.withColumn("weight", F.when((F.col("src") == "p1") & (F.col("dst") == "a"), 4.0).otherwise(1.0))
    adj = {(r["row"], r["col"]): round(r["w"], 6) for r in lightgcn.normalized_adjacency(lightgcn.weighted_pairs(heavy, "p")).collect()}
    assert adj[("p1", "a")] == 0.8 and adj[("p1", "b")] == adj[("p2", "a")] == 0.447214
    small = edges_of(spark, "p1>a").withColumn("weight", F.lit(0.5))
    assert rows(lightgcn.normalized_adjacency(lightgcn.weighted_pairs(small, "p")), "w") == [(0.5,), (0.5,)]


def test_propagation_and_scoring(spark):
    e = edges_of(spark, "p1>a p1>b p2>a")
    adj = lightgcn.normalized_adjacency(lightgcn.weighted_pairs(e, "p"))
    names = ["p1", "p2", "a", "b"]
    e0 = spark.createDataFrame([(n, d, float(k == d)) for k, n in enumerate(names) for d in range(4)], "id string, d int, x double")
    out = {(r["id"], r["d"]): round(r["x"], 6) for r in lightgcn.propagate(e0, adj, 3).collect()}
    expected = [[0.4375, 0.088388, 0.28125, 0.309359], [0.088388, 0.375, 0.309359, 0.0625], [0.28125, 0.309359, 0.4375, 0.088388], [0.309359, 0.0625, 0.088388, 0.375]]
    assert all(out[(n, d)] == expected[k][d] for k, n in enumerate(names) for d in range(4))
    v = lightgcn.as_vectors(lightgcn.propagate(e0, adj, 3))
    users, items = v.where(F.col("id").startswith("p")), v.where(~F.col("id").startswith("p"))
    got = rows(lightgcn.score_top_k(users, items, 2, block=1), "user", "rank", "item", "score")
    assert [(u, i) for u, _, i, _ in got] == [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b")]
    assert np.allclose([s for *_, s in got], [0.300781, 0.281738, 0.281738, 0.101562], atol=1e-6)
    seen = spark.createDataFrame([("p1", "a")], "user string, item string")
    assert rows(lightgcn.score_top_k(users, items, 1, seen), "user", "item") == [("p1", "b"), ("p2", "a")]


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(1)
    users, items, w = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 2, 4]), np.array([0.3, 2.0, 1.0, 0.4, 1.5])
    adjacency = training.SparseMatrix(users, items, w, 4, 9)
    e0 = rng.normal(size=(9, 3))
    batch = np.array([0, 1, 2, 3]), np.array([4, 5, 6, 8]), np.array([7, 7, 4, 5])
    _, g = training.loss_and_gradient(e0, adjacency, 2, *batch, 0.1)
    for at in np.ndindex(*e0.shape):
        up, down = e0.copy(), e0.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        slope = (training.loss_and_gradient(up, adjacency, 2, *batch, 0.1)[0] - training.loss_and_gradient(down, adjacency, 2, *batch, 0.1)[0]) / 2e-5
        assert abs(slope - g[at]) < 1e-7


def test_training_separates_clusters(spark, tmp_path):
    options = dict(embedding_dim=16, epochs=300, batch_size=8, learning_rate=0.05)
    with Graph(spark, Config("train", "bipartite", mode="serving")) as g:
        for u, i in (("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "b"), ("p3", "c"), ("p3", "d"), ("p4", "c"), ("p4", "d")):
            g.insert_edge(u, i, "x")
        assert not g.embeddings_ready
        with pytest.raises(EmbeddingsNotReady):
            g._resolve("lightgcn")(g, seed(spark, "p1"), "content")
        fallback = g.recommend("p1", algorithm="lightgcn")  # salsa instead, which isn't kept
        assert fallback.columns == ["seed", "id", "score", "rank"] and not g.store._held
        path = str(tmp_path / "model")
        info = g.train_embeddings(path, "p", **options)
        assert (info["user_count"], info["item_count"], info["version"]) == (4, 4, 1)
        g.load_embeddings(path)
        assert g.embeddings_ready
        v = {r["id"]: np.array(r["v"]) for r in g.model.collect()}
        assert np.isfinite(np.stack(list(v.values()))).all() and v["p1"] @ v["p2"] > v["p1"] @ v["p3"]
        best = g.recommend("p1", algorithm="lightgcn", top_k=2)
        assert {r["id"] for r in best.collect()} == {"a", "b"}
        assert {r["id"] for r in g.recommend("p1", algorithm="lightgcn", top_k=2, exclude_seen=True).collect()} == {"c", "d"}
        assert g.recommend("nobody", algorithm="lightgcn").count() == 0
        with pytest.raises(InvalidEmbeddings):
            g.load_embeddings(str(tmp_path / "none"))


def test_sharded_training_takes_the_same_steps(spark):
    """Three steps over tables against the same steps over arrays, from the same initial values and with the same draws."""
    edges = edges_of(spark, "user:a>item:1 user:a>item:2 user:b>item:2 user:c>item:3 user:c>item:1 user:d>item:3")
    vertices = storage.vertices(edges).unionByName(seed(spark, "item:9"))
    options = training.TrainingOptions(embedding_dim=3, layers=2, epochs=3, batch_size=4, learning_rate=0.05, regularization=0.1, seed=5, sharded=True)
    got, losses = training.train_sharded(lightgcn.weighted_pairs(edges, "user:"), vertices, "user:", options)
    order = sorted(r["id"] for r in vertices.collect())
    u, i = [x for x in order if x.startswith("user:")], [x for x in order if not x.startswith("user:")]
    pairs = sorted((r["user"], r["item"], r["weight"]) for r in lightgcn.weighted_pairs(edges, "user:").collect())
    users, items = np.array([u.index(a) for a, _, _ in pairs]), np.array([i.index(b) for _, b, _ in pairs])
    n = len(u) + len(i)
    adjacency = training.SparseMatrix(users, items, np.array([w for *_, w in pairs]), len(u), n)
    value = lambda row, d: int(hashlib.md5(f"5|{row}|{d}".encode()).hexdigest()[:8], 16) / 2**32 * 2 - 1
    e0 = np.array([[value(r, d) for d in range(3)] for r in range(n)]) * np.sqrt(6 / (n + 3))
    rng, m, v = np.random.default_rng(5), np.zeros_like(e0), np.zeros_like(e0)
    for step in range(1, 4):
        pick, other = rng.integers(0, len(pairs), 4), rng.integers(0, len(i), 4) + len(u)
        loss, g = training.loss_and_gradient(e0, adjacency, 2, users[pick], items[pick] + len(u), other, 0.1)
        assert abs(losses[step - 1] - (loss - 0.1 * np.mean(e0**2))) < 1e-9
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        e0 = e0 - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    expected = dict(zip(u + i, adjacency.propagate(e0, 2)))
    found = {r["id"]: np.array(r["v"]) for r in got.collect()}
    assert set(found) == set(expected) and all(np.allclose(found[k], expected[k], atol=1e-7) for k in expected)
    assert training.train(edges, vertices, "user:", options).count() == n


def test_loss_falls():
    users, items = np.repeat(np.arange(6), 3), np.concatenate([[k % 3, (k + 1) % 3, 3 + k % 2] for k in range(6)])
    _, losses = training.train_arrays(users, items, np.ones(18), 6, 6, training.TrainingOptions(8, 2, 200, 16, 0.05))
    assert np.mean(losses[-20:]) < np.mean(losses[:20])


@pytest.mark.parametrize("text", ["", "p1>p2", "a>b"])
def test_training_needs_both_sides(spark, text):
    e = edges_of(spark, text) if text else spark.createDataFrame([], "src string, dst string, etype string, weight double")
    with pytest.raises(lightgcn.EmptyGraph):
        training.train(e, storage.vertices(e), "p")


# -- evaluation


def test_metrics(spark):
    ranking_ = spark.createDataFrame([("u", f"i{k}", k) for k in (1, 2, 3)], "user string, item string, rank int")
    relevant = spark.createDataFrame([("u", "i2"), ("u", "i4")], "user string, item string")
    m = evaluation.mean_metrics(evaluation.per_user_metrics(ranking_, relevant, 3)).first()
    assert (m["users"], m["recall"], round(m["precision"], 6), round(m["ndcg"], 6)) == (1, 0.5, 0.333333, 0.386853)
    train = spark.createDataFrame([("u", "i1"), ("w", "i2"), ("w", "i3")], "user string, item string")
    assert evaluation.random_baseline(train, relevant, 1).first()["baseline"] == 0.5


# -- dispatch, cache, plugins, telemetry


def test_recommend_dispatch(spark):
    clock, told = Clock(), []
    with Graph(spark, Config("serve", "directed", result_ttl=10), clock=clock) as g:
        g.telemetry.attach(lambda event, meta, seconds: told.append(event))
        for a, b in (("A", "B"), ("B", "C"), ("C", "A")):
            g.insert_edge(a, b, "x")
        first = g.recommend("A")
        assert g.recommend("A") is first and g.recommend("A", top_k=1) is not first
        clock.now = 10
        assert g.recommend("A") is not first
        assert g.recommend("?").count() == 0 and g.recommend("?", algorithm="global_rank").count() == 3
        own = g.recommend(["A", "B"], algorithm=lambda graph, seeds, kind, **o: seeds)
        assert rows(own) == [("A",), ("B",)]
        with pytest.raises(ValueError):
            g.recommend("A", algorithm="none")
        assert "query.recommend.start" in told and "query.recommend.stop" in told and "query.recommend.exception" in told
    with Graph(spark, Config("compat", "directed", cache_key="compat")) as g:
        g.insert_edge("A", "B", "x")
        assert g.recommend("A", top_k=5) is g.recommend("A", top_k=1)


def test_failures_are_not_kept_and_plugins_go_on(spark):
    turns = []

    class Failing(PeriodicPlugin):
        def __init__(self, graph):
            super().__init__(graph, 5)

        def run(self):
            turns.append(1)
            raise RuntimeError

    with Graph(spark, Config("fails", "directed", plugins=(Failing,))) as g:
        broken = lambda graph, seeds, kind: seeds.select(F.raise_error(F.lit("no")).alias("id"))
        with pytest.raises(Exception, match="no"):
            g.recommend("A", algorithm=broken)
        assert not g.store._held
        waited = time.monotonic()
        while len(turns) < 2 and time.monotonic() - waited < 10:
            time.sleep(0.01)
    assert len(turns) >= 2
    assert [p.__name__ for p in Config("d", "directed").plugins] == ["Pruner", "CacheCleaner"]


def test_store():
    clock, dropped = Clock(), []
    s = MemoryStore(clock, dropped.append)
    s.put("a", 1, 1), s.put("b", 2, 1), s.put("c", 3, 100), s.put("d", 4, None)
    clock.now = 1
    assert s.get("a") == (False, None) and dropped == [1]
    s.put("a", 1, 0)
    assert s.clean_expired() == 2 and s.get("c") == (True, 3) and s.get("d") == (True, 4)
    s.delete("c")
    s.clear()
    assert s.get("d") == (False, None)


def test_plugins(spark):
    clock = Clock()
    with Graph(spark, Config("plug", "directed", segment_max_edges=1, segment_ttl=5, mode="batch"), clock=clock) as g:
        for bad in (0, -1, None, 1.5):
            with pytest.raises(ValueError):
                Pruner(g, bad)
        told = []
        g.telemetry.attach(lambda event, meta, seconds: told.append((event, meta.get("count"))))
        g.insert_edge("a", "b", "x")
        g.insert_edge("b", "c", "x")
        clock.now = 100
        assert Pruner(g).tick() == 1 and told[-1] == ("plugin.prune.stop", 1)
        g.store.put("k", g.edges, 1)
        clock.now = 200
        assert CacheCleaner(g).tick() == 1


def test_span_tells_of_failures():
    t, told = Telemetry(), []
    t.attach(lambda event, meta, seconds: told.append(event))
    with pytest.raises(KeyError), t.span("work"):
        raise KeyError
    assert told == ["work.start", "work.exception"] and math.isfinite(len(told))


def test_popular_unseen(spark):
    train = spark.createDataFrame([("u", "a"), ("w", "a"), ("x", "a"), ("w", "b"), ("x", "b"), ("x", "c")], "user string, item string")
    users = seed(spark, "u", "w", "new").withColumnRenamed("id", "user")
    assert rows(evaluation.popular_unseen(train, users, 2), "user", "rank", "item") == [("new", 1, "a"), ("new", 2, "b"), ("u", 1, "b"), ("u", 2, "c"), ("w", 1, "c")]


def test_row_index(spark):
    v = storage.vertices(edges_of(spark, "u2>b u1>a u1>b"))
    assert rows(lightgcn.row_index(v, "u"), "row", "id", "side") == [(0, "u1", "user"), (1, "u2", "user"), (2, "a", "item"), (3, "b", "item")]
