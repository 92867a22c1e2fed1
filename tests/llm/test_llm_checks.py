"""The checks that queries state about packings and mixes do tell a wrong one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, packing
from graphloom.runtime import materialize

SOUND = {"over_capacity": 0, "overlapping": 0, "wrongly_cut": 0, "of_two_tiers": 0, "every_token_once": True, "nearly_full": True, "even_groups": True}


def told(packed, sizes):
    row = packing.packing_checks(packed, sizes, "d", "n", 64).first().asDict()
    return {k for k, v in SOUND.items() if row[k] != v}


def test_packing_checks_tell_faults(spark):
    sizes = spark.createDataFrame([(k, (k * 37) % 200) for k in range(500)] + [(900, None), (901, 0), (902, 6400)], "d int, n bigint")
    packed = materialize(packing.pack(sizes, "d", "n", 64))
    assert told(packed, sizes) == set()
    row = packing.packing_checks(packed, sizes, "d", "n", 64).first()
    assert row["texts"] == 503 and row["without_container"] == sizes.where("n IS NULL OR n = 0").count()
    assert "every_token_once" in told(packed.where("d <> 7 OR piece <> 0"), sizes)
    assert {"over_capacity", "overlapping"} <= told(packed.withColumn("container", F.when(F.col("container") == 1, 0).otherwise(F.col("container"))), sizes)
    assert "overlapping" in told(packed.withColumn("position", F.lit(0).cast("long")), sizes)
    assert "even_groups" in told(packed.withColumn("step_group", F.when(F.col("container") > 3, 1).otherwise(0)), sizes)
    assert told(packing.pack(sizes.limit(0), "d", "n", 64), sizes.limit(0)) == set()


def test_mix_checks_tell_faults(spark):
    docs = spark.createDataFrame([(k, "ab"[k % 2], bytes([k % 256, k // 256]), 10) for k in range(1000)] + [(5000, "other", b"x", 5)], "doc_id int, source string, content binary, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 1), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    mix = materialize(mixing.select_mix(docs, mixing.read_targets(targets)))
    of = lambda m: {r["source"]: (r["has_documents"], r["share_met"], r["within_repeats"]) for r in mixing.mix_checks(m, docs, targets).collect()}
    assert of(mix) == {"a": (True, True, True), "b": (True, True, True), "none": (False, True, True)}
    assert of(mix.where("source = 'a' OR doc_id % 3 = 0"))["b"][1] is False
    assert of(mix.withColumn("uses", F.lit(2)))["a"][2] is False


@pytest.mark.parametrize("kept", [1, 3])
def test_rare_patterns_are_offered_to_one_of_their_sources(spark, monkeypatch, kept):
    """More combinations of sources than are routed as such: every text stays available, shares and caps hold."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", kept)
    names = [f"s{k}" for k in range(40)]
    rows = [(1000 * k + j, names[(k + j * step) % 40], bytes([k, 7]), 10) for k in range(200) for j, step in ((0, 1), (1, 1 + k % 5))]
    docs = spark.createDataFrame(rows, "doc_id int, source string, content binary, n_tokens bigint")
    targets = [mixing.Target(n, 1 / 40, 2) for n in names]
    got = mixing.select_mix(docs, targets, seed=3).collect()
    used = {}
    for r in got:
        used[r["source"]] = used.get(r["source"], 0) + r["uses"] * r["n_tokens"]
    assert set(used) == set(names) and max(used.values()) - min(used.values()) <= 20
    assert max(r["uses"] for r in got) <= 2
