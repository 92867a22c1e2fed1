"""Mixes of many combinations of sources against what can be had at most."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import mixing


def test_texts_of_rare_combinations_go_where_they_are_needed(spark):
    """A text in each of 780 pairs of sources, all of which the mix takes: a source of rare combinations alone gets every text it may have."""
    names = [f"s{k:02}" for k in range(40)]
    pairs = list(itertools.combinations(names, 2))
    rows = [(2 * k + j, name, k.to_bytes(2, "big"), 10) for k, pair in enumerate(pairs) for j, name in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, content binary, n_tokens bigint")
    targets = [mixing.Target(n, 39 / 780 if n == "s00" else 19 / 780, 1) for n in names]
    got = mixing.select_mix(docs, targets).collect()
    assert Counter(r["source"] for r in got) == {n: 39 if n == "s00" else 19 for n in names}
    assert sorted(r["doc_id"] // 2 for r in got) == list(range(780)) and all(r["uses"] == 1 for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_routing_is_a_cheapest_largest_flow(seed):
    """Against every choice of a cut: what small mixes get in all, and in each level of repetition."""
    rng = random.Random(seed)
    names = "abcde"
    for _ in range(40):
        combinations = [frozenset(c) for n in (1, 2, 3, 4) for c in itertools.combinations(names, n)]
        patterns = {p: rng.choice([1, 7, 10, 60, 500]) for p in rng.sample(combinations, rng.randint(1, 12))}
        targets = [mixing.Target(n, rng.choice([0.1, 0.2, 0.3]), rng.choice([1, 1, 2, 4])) for n in names]
        caps, total = {t.source: t.max_repeats for t in targets}, rng.choice([50, 400, 3000])

        def most(quotas, uses):  # the least cut: quotas of the sources outside, what patterns can give those inside
            cuts = []
            for n in range(len(quotas) + 1):
                for inside in map(set, itertools.combinations(quotas, n)):
                    given = sum(t * min(min(uses, max(caps[s] for s in p)), sum(min(uses, caps[s]) for s in p & inside)) for p, t in patterns.items())
                    cuts.append(given + sum(q for s, q in quotas.items() if s not in inside))
            return min(cuts)

        quotas = {t.source: round(t.share * total) for t in targets}
        flow = mixing.route(patterns, targets, total)
        of_pattern, of_source = Counter(), Counter()
        for (p, s), amount in flow.items():
            assert s in p and 0 < amount <= caps[s] * patterns[p]
            of_pattern[p] += amount
            of_source[s] += amount
        assert all(amount <= quotas[s] for s, amount in of_source.items())
        for uses in range(1, 5):
            assert sum(min(amount, uses * patterns[p]) for p, amount in of_pattern.items()) == most(quotas, uses)
        assert sum(any(amount % patterns[p] for (q, _), amount in flow.items() if q == p) for p in patterns) <= len(names)
        largest = mixing.largest_total(patterns, targets)
        supplied = [t for t in targets if any(t.source in p for p in patterns)]
        fits = lambda n: most({t.source: int(t.share * n + 1e-6) for t in supplied}, 4) == sum(int(t.share * n + 1e-6) for t in supplied)
        assert fits(largest) and not fits(largest + 20)


def test_sums_beyond_64_bits():
    names = [f"s{k}" for k in range(6)]
    targets = [mixing.Target(n, 1 / 6, 2**31 - 1) for n in names]
    patterns = {frozenset(c): 10**9 + k for k, c in enumerate(itertools.combinations(names, 2))}
    flow = mixing.route(patterns, targets, 10**11)
    assert sum(flow.values()) == pytest.approx(10**11, abs=6)
    with pytest.raises(ValueError):
        mixing.largest_total(patterns, targets)
    many = mixing.Supply(np.full(4000, 10**14), np.full(4000, 2), np.tile([0, 1], 4000), [mixing.Target("a", 0.5, 2**31 - 1), mixing.Target("b", 0.5, 1)])
    total = many.largest_total()
    assert total == pytest.approx(2 * 4000 * 10**14, rel=1e-9) and many.per_source(many.route(total)).tolist() == [total // 2, total // 2]


def test_what_is_broadcast_changes_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(10 * k + j, name, k.to_bytes(2, "big"), 1 + k % 50) for k in range(500) for j, name in enumerate(rng.sample("abcdefgh", rng.randint(1, 4)))]
    docs = spark.createDataFrame(rows, "doc_id int, source string, content binary, n_tokens bigint")
    targets = [mixing.Target(n, 1 / 8, 3) for n in "abcdefgh"]
    whole = sorted(mixing.select_mix(docs, targets, seed=4).collect())
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    assert whole and sorted(mixing.select_mix(docs, targets, seed=4).collect()) == whole
    assert mixing.select_mix(docs, targets, 0).count() == 0
