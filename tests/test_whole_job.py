"""Queries do the whole job: every user, the operators' defaults, every copy and value."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from graphloom.operators import skew, training
from graphloom.plans import graph_queries
from graphloom.runtime import load
from tests.conftest import SF


def of(spark, name):
    return entry_points.queries()[name](spark, SF)


@pytest.mark.parametrize("name", ["neighbors_of_all_users", "ppr_exact_all_users", "ppr_monte_carlo_all_users", "circle_of_trust_all_users"])
def test_every_user_is_a_seed(spark, name):
    users = {f"user:{r[0]}" for r in load(spark, SF, "events").where("user_id IS NOT NULL").select("user_id").distinct().collect()}
    column = "id" if name.startswith("neighbors") else "seed"
    assert {r[0] for r in of(spark, name).select(column).distinct().collect()} == users


def test_propagation_has_the_default_dimensions(spark):
    assert of(spark, "propagate_k").select("d").distinct().count() == 64


def test_walks_and_circles_have_the_default_sizes(spark):
    visits = of(spark, "ppr_monte_carlo_all_users").groupBy("seed").agg(F.sum("visits").alias("n"))
    assert {r["n"] for r in visits.collect()} == {10_000.0}
    circle = of(spark, "circle_of_trust_all_users").groupBy("seed").count()
    assert circle.agg(F.max("count")).first()[0] == 100


def test_training_covers_the_pairs():
    default, used = training.TrainingOptions(), graph_queries.TRAINING
    for name in ("embedding_dim", "layers", "epochs", "batch_size", "learning_rate", "regularization"):
        assert getattr(used, name) == getattr(default, name)
    options = training.TrainingOptions(embedding_dim=4, layers=1, epochs=1, batch_size=4, draws_per_pair=5)
    at = np.arange(10)
    assert len(training.train_arrays(at, at, np.ones(10), 10, 10, options)[1]) == 13
    assert len(training.train_arrays(at, at, np.ones(10), 10, 10, training.TrainingOptions(epochs=3))[1]) == 3


def test_values_left_out_are_told(spark):
    data = [(1, 1, 2.0), (1, 2, 1e20), (1, 3, float("-inf")), (1, 4, None), (2, 1, float("nan")), (2, 1, 3.0)]
    df = spark.createDataFrame(data, "k int, m int, v double")
    for share in (0.5, 1.0):
        got = skew.per_key_stats(df, "k", "m", "v", share=share, tell_left_out=True)
        assert {r["k"]: (r["total"], r["left_out"]) for r in got.collect()} == {1: (2.0, 2), 2: (3.0, 0)}


def test_trained_embeddings_are_evaluated(spark):
    got = of(spark, "eval_lightgcn").collect()
    assert len(got) == 1
    assert got[0]["users"] == of(spark, "eval_metrics").first()["users"]
    assert got[0]["baseline"] == of(spark, "random_baseline").first()["baseline"] > 0
    assert 0 < got[0]["recall"] <= 1 and abs(got[0]["uplift"] - got[0]["recall"] / got[0]["baseline"]) < 1e-4


def test_dense_graphs_train_without_passes_over_their_entries(monkeypatch):
    rng = np.random.default_rng(3)
    for n_users, n_items in ((40, 9), (9, 40)):
        users, items = np.divmod(rng.choice(360, 150, replace=False), n_items)
        options = training.TrainingOptions(embedding_dim=4, layers=3, epochs=20, batch_size=16)
        data = users, items, rng.uniform(0.1, 3, 150), n_users, n_items, options
        with monkeypatch.context() as m:
            m.setattr(training, "DENSE_SHARE", 2.0)
            by_entries, losses = training.train_arrays(*data)
        with monkeypatch.context() as m:
            m.setattr(training.SparseMatrix, "__matmul__", None)
            dense, same = training.train_arrays(*data)
        assert np.allclose(dense, by_entries, atol=1e-12) and np.allclose(same, losses, atol=1e-12)


def test_salsa_with_feedback_asks_for_every_user(spark):
    users = {f"user:{r[0]}" for r in load(spark, SF, "events").where("user_id IS NOT NULL").select("user_id").distinct().collect()}
    for name in ("salsa_feedback", "salsa_feedback_all_users"):
        assert {r[0] for r in entry_points.queries()[name](spark, SF).select("seed").distinct().collect()} == users
    assert "% 20" not in entry_points.oracle_sql()["salsa_feedback"]
