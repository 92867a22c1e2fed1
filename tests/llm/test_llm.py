"""The training-data operators against brute force and on awkward input."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import cooccurrence, encoding_repair, mixing, packing, prefix, similar_vectors, tokens, topn
from tests.conftest import rows

# -- top N


@pytest.mark.parametrize("share, salt_rows", [(0.001, 100_000), (0.3, 20), (1.0, 1)])
def test_top_n_matches_brute_force(spark, share, salt_rows):
    rng = random.Random(1)
    data = [(1 if rng.random() < 0.5 else rng.choice([None, 2, 3, 4]), rng.choice([None, *range(40)]), rng.choice([None, float("nan"), 0.5, 1.0, -1.0, 2.0])) for _ in range(800)]
    best = defaultdict(lambda: -math.inf)
    for g, i, s in data:
        if None not in (g, i, s) and s == s:
            best[g, i] = max(best[g, i], s)
    expected = []
    for g in sorted({g for g, _ in best}):
        mine = sorted((-s, i) for (h, i), s in best.items() if h == g)[:5]
        expected += [(g, k + 1, i, -s) for k, (s, i) in enumerate(mine)]
    df = spark.createDataFrame(data, "u int, item int, w float").withColumns({c: F.lit(0) for c in ("g", "i", "s", "salt", "salts", "rank", "size")})
    assert rows(topn.top_n(df, "u", "item", "w", 5, share, salt_rows), "u", "rank", "item", "w") == expected
    assert topn.top_n(df.limit(0), "u", "item", "w").count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "u", "item", "w", 0)


def test_top_n_of_whole_numbers_and_signed_zeros(spark):
    df = spark.createDataFrame([(1, 5, 2**53 + 1), (1, 4, 2**53), (1, 3, None)], "u int, x int, w bigint")
    assert rows(topn.top_n(df, "u", "x", "w", 2), "rank", "x", "w") == [(1, 5, 2**53 + 1), (2, 4, 2**53)]
    zeros = spark.createDataFrame([(1, 5, -0.0), (1, 6, 0.0)], "u int, x int, w double")
    assert rows(topn.top_n(zeros, "u", "x", "w", 2), "rank", "x") == [(1, 5), (2, 6)]


# -- items together


@pytest.mark.parametrize("block", [2, 3, 256])
def test_pairs_match_brute_force(spark, block):
    rng = random.Random(2)
    data = [(rng.choice([None, *range(12)]), rng.choice([None, *range(15)])) for _ in range(300)] + [(99, k) for k in range(15)] * 2
    baskets = defaultdict(set)
    for b, i in data:
        if b is not None and i is not None:
            baskets[b].add(i)
    both = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    one = Counter(i for s in baskets.values() for i in s)
    df = spark.createDataFrame(data, "b int, x int").withColumns({c: F.lit(0) for c in ("item", "size", "n", "tile", "b0")})
    got = cooccurrence.associations(df, [F.col("b")], "x", 3, 1, block)
    expected = sorted((a, b, c, one[a], one[b], len(baskets)) for (a, b), c in both.items() if c >= 3 and c * len(baskets) >= one[a] * one[b])
    assert rows(got, "item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets") == expected
    r = cooccurrence.associations(df, [F.col("b")], "x", 3, 0.5, block).first()
    assert abs(2 ** r["pmi"] - r["lift"]) < 1e-9 and abs(r["lift"] - r["n_both"] * r["n_baskets"] / r["n_a"] / r["n_b"]) < 1e-12
    assert cooccurrence.associations(df.limit(0), [F.col("b")], "x").count() == 0


# -- similar vectors


def vectors_of(spark, n, dim=8, copies=0, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    data = [(k, [float(np.float32(x)) for x in centres[k % 6] + 0.3 * rng.normal(size=dim)]) for k in range(n)]
    data += [(n + k, data[0][1]) for k in range(copies)]
    odd = [None, [1.0] * (dim - 1), [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1)]
    data += [(10_000 + k, v) for k, v in enumerate(odd)] + [(None, data[1][1])]
    return data, spark.createDataFrame(data, "x int, e array<float>").withColumns({c: F.lit(0) for c in ("item", "v", "perm", "size")})


def brute_neighbours(data, dim, k):
    usable = [(i, np.array(v)) for i, v in data if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in usable]
    out = {}
    for i, v in unit:
        near = sorted((-round(float(v @ w), 6), j) for j, w in unit if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("n, copies, block", [(60, 0, 4096), (60, 25, 7), (3, 0, 4096), (1, 9, 4096)])
def test_neighbours_match_brute_force(spark, n, copies, block):
    data, df = vectors_of(spark, n, copies=copies)
    expected = brute_neighbours(data, 8, 5)
    got = defaultdict(list)
    for r in similar_vectors.most_similar(df, "x", "e", 8, 5, block=block).orderBy("item_a", "rank").collect():
        got[r["item_a"]].append(r["item_b"])
    assert dict(got) == {k: v for k, v in expected.items() if v}


def test_index_recall_and_queries(spark):
    data, df = vectors_of(spark, 900, seed=4)
    asking = df.where(F.col("x") % 20 == 0).select(F.col("x").alias("item"))
    true = set(rows(similar_vectors.exact_neighbours(df, "x", "e", 8, 5, asking, 100), "item_a", "item_b"))
    found = set(rows(similar_vectors.most_similar(df, "x", "e", 8, 5, asking), "item_a", "item_b"))
    expected = brute_neighbours(data, 8, 5)
    assert true == {(a, b) for a, near in expected.items() if a % 20 == 0 for b in near}
    assert len(true & found) >= 0.95 * len(true) and len(found) == len(true)
    assert similar_vectors.most_similar(df.limit(0), "x", "e", 8).count() == 0


def test_recall_holds_for_vectors_without_structure(spark, tmp_path):
    """60,000 vectors evenly spread in 32 dimensions, the hardest case: files are far longer than what is reranked at least."""
    n, every = 60_000, 600
    vectors = np.random.default_rng(7).standard_normal((n, 32)).astype(np.float32)
    pq.write_table(pa.table({"x": np.arange(n), "e": pa.array(list(vectors), pa.list_(pa.float32()))}), tmp_path / "v.parquet", row_group_size=10_000)
    df = spark.read.parquet(f"file://{tmp_path}/v.parquet")
    asking = df.where(F.col("x") % every == 0).select(F.col("x").alias("item"))
    found = set(rows(similar_vectors.most_similar(df, "x", "e", 32, 5, asking), "item_a", "item_b"))
    unit = vectors.astype(float) / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = {(a, int(b)) for a in range(0, n, every) for b in np.argsort(-(unit @ unit[a]))[1:6]}
    assert len(true & found) >= 0.9 * len(true)


def test_copies_of_a_vector_and_string_ids(spark):
    """A third of the rows are one vector: every member has the lowest other members as neighbours, and answers by the lowest."""
    data = [(f"i{k:03d}", [1.0, 0.0] if k % 3 == 0 else [float(k), float(k * k % 7 + 1)]) for k in range(60)]
    df = spark.createDataFrame(data, "x string, e array<float>")
    got = defaultdict(list)
    for r in similar_vectors.most_similar(df, "x", "e", 2, 5).orderBy("item_a", "rank").collect():
        got[r["item_a"]].append(r["item_b"])
    copies = [x for x, v in data if v == [1.0, 0.0]]
    assert all(got[x] == [c for c in copies if c != x][:5] for x in copies)
    assert dict(got) == brute_neighbours(data, 2, 5)


# -- sizes and prefix sums


def test_token_counts(spark):
    text = "Olá, mundo! <|endoftext|> Привет  \n\n" + "word " * 3000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, t string")
    encode = tokens._encoding(tokens.TOKENIZER)
    got = dict(rows(tokens.count_tokens(df, "t", keep=("i",)), "i", "n_tokens"))
    assert got == {1: len(encode.encode_ordinary(text)), 2: 0, 3: None}
    assert encode.decode(encode.encode_ordinary(text)) == text


@pytest.mark.parametrize("bucket_rows", [1, 7, 100_000])
def test_running_total(spark, bucket_rows):
    df = spark.range(200).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), (F.col("id") % 7 + 1).alias("a"))
    got = rows(prefix.running_total(df, ["g"], "h", ["id"], "a", "s", bucket_rows), "g", "s", "a")
    for g in range(3):
        at = 0
        for _, s, a in sorted(r for r in got if r[0] == g):
            assert s == at
            at += a
    whole = rows(prefix.running_total(df, [], "h", ["id"], "a", "s", bucket_rows), "s", "a")
    assert [s for s, _ in whole] == [sum(a for _, a in whole[:k]) for k in range(200)]
    bits = spark.createDataFrame([(1,), (100_000,), (100_001,), (10**12,)], "n bigint").select(prefix.bucket_bits(F.col("n")))
    assert [r[0] for r in bits.collect()] == [0, 0, 1, 16]


# -- packing


@pytest.mark.parametrize("seed, capacity", [(1, 64), (2, 64), (3, 16)])
def test_packing_is_sound(spark, seed, capacity):
    rng = random.Random(seed)
    sizes = [(k, rng.choice([None, 0, 5, 5, 5, rng.randrange(1, capacity + 1), rng.randrange(1, 4 * capacity)])) for k in range(400)]
    df = spark.createDataFrame(sizes, "d int, size int").withColumns({c: F.lit(0) for c in ("id", "n", "h", "rank", "tier", "piece")})
    got = packing.pack(df, "d", "size", capacity, group_containers=4).collect()
    pieces, held = defaultdict(list), defaultdict(list)
    for r in got:
        if r["container"] is not None:
            pieces[r["d"]].append((r["piece"], r["piece_start"], r["n_tokens"]))
            held[r["container"]].append((r["position"], r["n_tokens"]))
    real = {d: s for d, s in sizes if s}
    assert {r["d"] for r in got if r["container"] is None} == {d for d, s in sizes if not s} and set(pieces) == set(real)
    for d, parts in pieces.items():
        parts.sort()
        assert sum(n for *_, n in parts) == real[d] and len(parts) == -(-real[d] // capacity)
        assert [s for _, s, _ in parts] == [k * capacity for k in range(len(parts))]
    for spots in held.values():
        spots.sort()
        assert all(a + n <= b for (a, n), (b, _) in itertools.pairwise(spots)) and spots[-1][0] + spots[-1][1] <= capacity
    least = -(-sum(real.values()) // capacity)
    assert len(held) <= least * 1.12 + 1 and set(held) == set(range(len(held)))
    groups = Counter(r["step_group"] for r in {r["container"]: r for r in got if r["container"] is not None}.values())
    assert max(groups.values()) - min(groups.values()) <= 1


def test_packing_edges(spark):
    df = spark.createDataFrame([], "d int, size int")
    assert packing.pack(df, "d", "size").count() == 0
    same = spark.range(1000).select(F.col("id").alias("d"), F.lit(512).alias("size"))
    packed = packing.pack(same, "d", "size")
    assert packed.select("container").distinct().count() == 250 and packing.packing_report(packed).agg(F.min("fill")).first()[0] == 1.0
    with pytest.raises(ValueError):
        packing.tiers_of(10, 2)


def test_plan_stays_small():
    histogram = {s: 1_000_000 + 37 * s for s in range(1, 2049)}
    plan = packing.plan_windows(histogram, 2048)
    used = Counter()
    for w in plan:
        assert sum(w.sizes) <= w.tier
        for s in w.sizes:
            used[s] += w.count
    assert used == histogram and len(plan) < 4 * 2048
    room = sum(w.count * w.tier for w in plan)
    assert sum(s * n for s, n in histogram.items()) / room > 0.99


# -- mixing


def test_route_uses_overlaps_and_repeats_least():
    t = [mixing.Target("a", 0.5, 2), mixing.Target("b", 0.5, 2)]
    shared = frozenset("ab")
    flow = mixing.route({frozenset("a"): 100, frozenset("b"): 20, shared: 80}, t, 200)
    assert sum(n for (_, s), n in flow.items() if s == "a") == sum(n for (_, s), n in flow.items() if s == "b") == 100
    assert flow[frozenset("b"), "b"] == 20 and flow[shared, "b"] == 80 and flow[frozenset("a"), "a"] == 100
    assert mixing.largest_total({frozenset("a"): 100, frozenset("b"): 20}, t) == pytest.approx(80, abs=1)
    assert mixing.largest_total({}, t) == 0
    short = mixing.route({frozenset("a"): 10, frozenset("b"): 100}, t, 100)
    assert short[frozenset("a"), "a"] == 20 and short[frozenset("b"), "b"] == 50


def mix_docs(spark, n=600, seed=5):
    rng = random.Random(seed)
    data = [(k, rng.choice(["a"] * 8 + ["b", "c", "x", None]), bytes([k // 250, k % 250]), rng.choice([None, 0, *range(1, 60)])) for k in range(n)]
    data += [(n + k, "b", d[2], d[3]) for k, d in enumerate(data[:30])] + [(n + 100 + k, "a", data[0][2], data[0][3]) for k in range(50)]
    return data, spark.createDataFrame(data, "doc_id bigint, source string, content binary, n_tokens bigint").withColumns({c: F.lit(0) for c in ("h", "pattern", "m0", "p", "lo")})


@pytest.mark.parametrize("total", [None, 3_000])
def test_mix_meets_its_shares(spark, total):
    data, df = mix_docs(spark)
    targets = [mixing.Target("a", 0.5, 1), mixing.Target("b", 0.3, 3), mixing.Target("c", 0.1, 2), mixing.Target("none", 0.1, 4)]
    got = mixing.select_mix(df, targets, total, seed=7).collect()
    of, caps = {d[0]: d for d in data}, {t.source: t.max_repeats for t in targets}
    spent, uses = Counter(), Counter()
    for r in got:
        d = of[r["doc_id"]]
        assert d[1] == r["source"] and d[3] == r["n_tokens"] and 1 <= r["uses"] <= caps[r["source"]]
        spent[r["source"]] += r["uses"] * r["n_tokens"]
        uses[d[2], r["source"]] += r["uses"]
    assert all(n <= caps[s] for (_, s), n in uses.items())
    whole = sum(spent.values()) / 0.9  # "none" has no documents
    assert all(abs(spent[t.source] / whole - t.share) < 0.03 for t in targets[:3])
    assert got == mixing.select_mix(df, targets, total, seed=7).collect()
    shares = spark.createDataFrame([(t.source, t.share, t.max_repeats) for t in targets], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mixing.mix_report(mixing.select_mix(df, targets, total, seed=7), shares).collect()}
    assert report["none"]["tokens"] == 0 and report["b"]["tokens"] == spent["b"] and mixing.read_targets(shares) == sorted(targets, key=lambda t: t.source)


def test_mix_of_nothing(spark):
    _, df = mix_docs(spark, 10)
    assert mixing.select_mix(df, []).count() == 0
    assert mixing.select_mix(df.limit(0), [mixing.Target("a", 1.0, 1)]).count() == 0
    assert mixing.select_mix(df, [mixing.Target("zz", 1.0, 1)]).count() == 0


# -- garbled text

CLEAN = [
    "A coordenação perdeu o relatório de opiniões até amanhã de manhã; três avaliações anônimas.", "El señor del archivo rechazó la contraseña; mañana, ¿qué tal?", "Die Prüfstelle kündigt übermorgen die geänderte Straßenliste an.",
    "L'équipe vérifiera la clé après la réunion — grâce à l'hôte, naïve.", "Новая сотрудница забыла прислать таблицу соседей до обеда.", "The café can’t open the “draft B” folder – it’s £12 or 4°.", "ВХОДА РЫНОК ЁЛКА СТОИТ ВСТРЕЧА", "ATENÇÃO: REUNIÃO ÀS 8H. NÃO É OPÇÃO.",
    "© √2 ¬ ± µm", "π ≈ · λ ΔT ≠", "附件已更新，请查收。", "przesyłka później", "🙂 👍 📎 ✓ №", "“NÃO” e “IRMÔ", "—Él dijo: «marché »", "plain =?UTF-8?Q?=C3=A9?= &eacute; =C3=A9 w6k=", "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert encoding_repair.Repairer().repair(text) is None


def passing(charset):
    """Decoding as browsers do: bytes without a character become controls."""
    table = {b: o for o, b in encoding_repair._to_bytes(charset).items()}
    return lambda data: "".join(chr(b) if b < 0x80 else chr(table[b]) for b in data)


@pytest.mark.parametrize("charset", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", CLEAN[:6])
def test_utf8_read_otherwise_is_restored(charset, text):
    garbled = passing(charset)(text.encode())
    found = encoding_repair.Repairer().repair(f"Subject: x\n{garbled}\n{CLEAN[0]}")
    assert found is not None and found[0] == f"Subject: x\n{text}\n{CLEAN[0]}"


@pytest.mark.parametrize("text", CLEAN[:4])
def test_two_layers_are_restored(text):
    twice = passing("cp1252")(passing("cp1252")(text.encode()).encode())
    assert encoding_repair.Repairer().repair(twice)[0] == text


@pytest.mark.parametrize("read_as, written_in, k", [("latin-1", "koi8-r", 4), ("latin-1", "cp1251", 4), ("cp1251", "koi8-r", 4), ("koi8-r", "cp1251", 4), ("cp1251", "cp866", 4), ("cp437", "cp1252", 0), ("mac_roman", "cp1252", 0), ("cp1251", "cp1252", 1)])
def test_other_mistakes_are_found_and_restored(read_as, written_in, k):
    garbled = passing(read_as)(CLEAN[k].encode(written_in))
    found = encoding_repair.Repairer().repair(garbled)
    assert found is not None
    same = sum(a == b for a, b in zip(found[0].split(), CLEAN[k].split()))
    assert same >= 0.8 * len(CLEAN[k].split())


@pytest.mark.parametrize("word", ["—", "4°", "£12", "§ 5", "1ª", "à", "É", "…", "“so”", "µm", "Índice"])
def test_a_single_garbled_sign_is_enough(word):
    garbled = passing("cp1252")(word.encode())
    assert encoding_repair.Repairer().repair(f"it is {garbled} here")[0] == f"it is {word} here"


def test_lost_originals_are_found():
    text, names, words, lost = encoding_repair.Repairer().repair("coordena��o ok")
    assert (text, names, words, lost) == ("coordena��o ok", "", 1, 1)


def test_repair_of_tables(spark):
    long = "é " * 200_000 + "cafÃ©"
    df = spark.createDataFrame([(1, "cafÃ©"), (2, "café"), (3, None), (4, ""), (5, long), (1, "cafÃ©")], "d bigint, t string").withColumns({c: F.lit(0) for c in ("id", "text", "repaired")})
    assert rows(encoding_repair.find_garbled(df, "d", "t")) == [(1,), (1,), (5,)]
    got = rows(encoding_repair.repair_texts(df, "d", "t"))
    assert got[0] == (1, "cp1252>utf-8", 1, 0, "café") and got[2][4].endswith("café") and len(got) == 3
    assert encoding_repair.find_garbled(df.limit(0), "d", "t").count() == 0
