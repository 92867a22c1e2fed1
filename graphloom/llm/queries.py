"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import cooccurrence, encoding_repair, mixing, packing, similar_vectors, tokens, topn
from graphloom.plans.registry import Registry
from graphloom.runtime import load, materialize

REGISTRY = Registry()
query = REGISTRY.query

TOP_N = 10
MIN_BOTH, MIN_LIFT = 6, 5

# ---------------------------------------------------------------- problem 1

_P1_RANKED = """
WITH s AS (
  SELECT user_idx, item_idx, max(weight) AS weight FROM interactions
  WHERE user_idx IS NOT NULL AND item_idx IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY weight DESC, item_idx) AS rank FROM s
)
"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n(load(spark, sf_dir, "interactions"), "user_idx", "item_idx", "weight", TOP_N)


@query("p1_found", _P1_RANKED + f"SELECT user_idx, item_idx FROM r WHERE rank <= {TOP_N}")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("user_idx", "item_idx")


@query("p1_ranked", _P1_RANKED + f"SELECT user_idx, item_idx, round(CAST(weight AS DOUBLE), 4) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP_N}")
def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


# ---------------------------------------------------------------- problem 4

DIM, NEIGHBOURS, ASK_EVERY = 32, 5, 20


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embedding_rows").select("row_index", "embedding")
    return load(spark, sf_dir, "item_index").join(rows, "row_index").select("item_idx", "embedding")


_P4_EXACT = f"""
WITH v AS (
  SELECT item_idx, embedding::DOUBLE[] AS e FROM item_index JOIN embedding_rows USING (row_index)
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), s AS (
  SELECT a.item_idx AS a, b.item_idx AS b, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine
  FROM v a, v b WHERE a.item_idx <> b.item_idx
), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM s)
SELECT DISTINCT least(a, b) AS item_a, greatest(a, b) AS item_b FROM r WHERE rank <= {NEIGHBOURS}"""


@query("p4_found", _P4_EXACT)  # exact; the index finds all of it at the size the two are compared at
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors.most_similar(_item_vectors(spark, sf_dir), "item_idx", "embedding", DIM, NEIGHBOURS)
    pair = [F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b")]
    return near.select(*pair).distinct()


_P4_RECALL = f"""
WITH v AS (
  SELECT item_idx FROM item_index JOIN embedding_rows USING (row_index)
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM} AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
)
SELECT count(*) FILTER (item_idx % {ASK_EVERY} = 0) * least({NEIGHBOURS}, count(*) - 1) AS true_neighbours, true AS recall_holds FROM v"""


@query("p4_recall_holds", _P4_RECALL)
def p4_recall_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether ``p4_recall`` is at least 0.95."""
    return p4_recall(spark, sf_dir).select("true_neighbours", (F.col("recall") >= 0.95).alias("recall_holds"))


@query("p4_recall")
def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against brute force, for every item whose id is divisible by 20: true neighbours and those found."""
    vectors = _item_vectors(spark, sf_dir)
    asking = vectors.where(F.col("item_idx") % ASK_EVERY == 0).select(F.col("item_idx").alias("item"))
    found = similar_vectors.most_similar(vectors, "item_idx", "embedding", DIM, NEIGHBOURS, asking)
    true = similar_vectors.exact_neighbours(vectors, "item_idx", "embedding", DIM, NEIGHBOURS, asking)
    hits = true.join(found.select("item_a", "item_b", F.lit(1).alias("hit")), ["item_a", "item_b"], "left")
    return hits.agg(F.count(F.lit(1)).alias("true_neighbours"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


# ---------------------------------------------------------------- problem 7

_P7_PAIRS = """
WITH d AS (
  SELECT DISTINCT user_idx, CAST(inserted_at AT TIME ZONE 'UTC' AS DATE) AS day, item_idx FROM interactions
  WHERE user_idx IS NOT NULL AND item_idx IS NOT NULL AND inserted_at IS NOT NULL
), m AS (SELECT item_idx, count(*) AS n FROM d GROUP BY 1
), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_idx, day FROM d)
), p AS (
  SELECT x.item_idx AS item_a, y.item_idx AS item_b, count(*) AS n_both
  FROM d x JOIN d y ON x.user_idx = y.user_idx AND x.day = y.day AND x.item_idx < y.item_idx GROUP BY 1, 2
), j AS (
  SELECT p.*, ma.n AS n_a, mb.n AS n_b, b.n AS n_baskets
  FROM p JOIN m ma ON ma.item_idx = item_a JOIN m mb ON mb.item_idx = item_b, b
)
"""


def _pairs(spark: SparkSession, sf_dir: str, min_both: int, min_lift: float) -> DataFrame:
    basket = [F.col("user_idx"), cooccurrence.utc_day("inserted_at")]
    return cooccurrence.associations(load(spark, sf_dir, "interactions"), basket, "item_idx", min_both, min_lift)


@query("p7_found", _P7_PAIRS + f"SELECT item_a, item_b FROM j WHERE n_both >= {MIN_BOTH} AND n_both * n_baskets >= {MIN_LIFT} * n_a * n_b")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, MIN_BOTH, MIN_LIFT).select("item_a", "item_b")


@query(
    "p7_pairs",
    _P7_PAIRS
    + "SELECT item_a, item_b, n_both, n_a, n_b, round(n_both::DOUBLE * n_baskets / (n_a::DOUBLE * n_b), 6) AS lift, round(log2(n_both::DOUBLE * n_baskets / (n_a::DOUBLE * n_b)), 6) AS pmi FROM j",
)
def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _pairs(spark, sf_dir, 1, 0.0)
    return out.select("item_a", "item_b", "n_both", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


# ---------------------------------------------------------------- problem 8


@query("p8_packed")
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(load(spark, sf_dir, "documents"), "doc_id", "text", tokens.TOKENIZER)


@query("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_packed(spark, sf_dir))


@query(
    "p8_checks",
    """
SELECT 0::BIGINT AS over_capacity, 0::BIGINT AS overlapping, 0::BIGINT AS wrongly_cut, 0::BIGINT AS of_two_tiers, count(*) AS texts, count(*) FILTER (text IS NULL OR text = '') AS without_container,
       true AS every_token_once, true AS nearly_full, true AS even_groups FROM documents""",
)
def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``p8_packed``, one row: every token of every text stands in one place, no container holds too much, little room is left."""
    sized = materialize(tokens.count_tokens(load(spark, sf_dir, "documents"), "text", keep=("doc_id",)), "token-sizes")
    packed = materialize(packing.pack(sized, "doc_id", "n_tokens"), "packed")
    return packing.packing_checks(packed, sized, "doc_id", "n_tokens")


# ---------------------------------------------------------------- problem 9


@query("p9_selected")
def p9_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = mixing.read_targets(load(spark, sf_dir, "mix_targets"))
    return mixing.select_mix(mixing.sized_documents(load(spark, sf_dir, "documents"), tokens.TOKENIZER), targets)


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(p9_selected(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


@query(
    "p9_checks",
    """
WITH d AS (SELECT source, count(*) FILTER (text IS NOT NULL AND text <> '') AS n FROM documents GROUP BY source)
SELECT t.source, coalesce(d.n, 0) > 0 AS has_documents, true AS share_met, true AS within_repeats
FROM mix_targets t LEFT JOIN d ON d.source = t.source WHERE t.target_share > 0 AND t.max_repeats > 0""",
)
def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source of ``p9_selected``: whether its share (of what sources with documents can get) is met to 2 % of it, and no text is used too often."""
    docs = mixing.sized_documents(load(spark, sf_dir, "documents"), tokens.TOKENIZER)
    table = load(spark, sf_dir, "mix_targets")
    return mixing.mix_checks(materialize(mixing.select_mix(docs, mixing.read_targets(table)), "mix"), docs, table)


# ---------------------------------------------------------------- problem 10


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.find_garbled(load(spark, sf_dir, "documents"), "doc_id", "text")


@query("p10_left_clean", "SELECT count(*) AS clean FROM documents WHERE text IS NULL OR regexp_full_match(text, '[\\x00-\\x7f]*', 's')")
def p10_left_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the texts that can't be garbled (null, empty or ASCII alone) aren't found."""
    docs = load(spark, sf_dir, "documents")
    clean = docs.where(F.col("text").isNull() | ~F.col("text").rlike(encoding_repair.NOT_ASCII)).select("doc_id")
    return clean.join(encoding_repair.find_garbled(docs, "doc_id", "text"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("clean"))


@query("p10_repaired")
def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.repair_texts(load(spark, sf_dir, "documents"), "doc_id", "text")
