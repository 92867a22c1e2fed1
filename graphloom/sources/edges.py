"""Edge logs of the tables at hand, and synthetic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import draw, vertex_id
from graphloom.operators.sequence import number_rows
from graphloom.operators.storage import edge_log
from graphloom.runtime import load

# The weight of an event by its type.
EVENT_WEIGHTS = {"view": 0.5, "signup": 1.0, "purchase": 1.5, "click": 2.0, "error": 0.5}

LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def event_weight() -> F.Column:
    weight = F.lit(1.0)
    for kind, w in EVENT_WEIGHTS.items():
        weight = F.when(F.col("event_type") == kind, F.lit(w)).otherwise(weight)
    return weight


def activity(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """user -> item edges of all events; ``numbered`` adds ``seq`` in the order of (time, event)."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    log = edge_log(e, vertex_id("user", F.col("user_id")), vertex_id("item", F.col("k")), F.col("event_type"), event_weight(), F.col("ts"), F.col("event_id"))
    return number_rows(log, ["ts", "event_id"]).drop("event_id") if numbered else log.drop("event_id")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> part edges of all order lines."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = load(spark, sf_dir, "lineitem").select(*LINEITEM).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return edge_log(rows, vertex_id("customer", F.col("o_custkey")), vertex_id("part", F.col("l_partkey")), F.col("l_returnflag"), F.lit(1.0), F.col("o_orderdate").alias("ts"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile -> item edges of all interactions whose user and item are known; a null weight is 1.0, a NaN no edge.

    Users and items that are repeated as whole rows count once.
    """
    i = load(spark, sf_dir, "interactions").select("user_idx", "item_idx", "weight", "inserted_at").where(~F.isnan(F.coalesce("weight", F.lit(1.0))))
    u = load(spark, sf_dir, "users").select("user_idx", "profile_id").where(F.col("profile_id").isNotNull()).distinct()
    t = load(spark, sf_dir, "items").where(F.col("db_id").isNotNull()).select("item_idx", F.concat_ws(":", "tipo", F.col("db_id").cast("string")).alias("item")).distinct()
    rows = i.join(u, "user_idx").join(t, "item_idx")
    return edge_log(rows, vertex_id("profile", F.col("profile_id")), F.col("item"), F.lit("interaction"), F.col("weight"), F.col("inserted_at").alias("ts"))


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user -> user edges: each signup points at the next one in time."""
    s = load(spark, sf_dir, "events").where(F.col("event_type") == "signup").select("ts", "event_id", "user_id")
    numbered = number_rows(s, ["ts", "event_id"])
    following = numbered.select((F.col("seq") - 1).alias("seq"), F.col("user_id").alias("next_id"))
    return edge_log(numbered.join(following, "seq"), vertex_id("user", F.col("user_id")), vertex_id("user", F.col("next_id")), F.lit("follow"), F.lit(1.0), F.col("ts"), F.col("seq"))


def synthetic(spark: SparkSession, n_users: int, n_items: int, n_edges: int, seed: int = 42) -> DataFrame:
    """A reproducible random user -> item log with weights 0.5, 1, 1.5 and 2."""
    n = spark.range(1, n_edges + 1).withColumnRenamed("id", "seq")
    pick = lambda channel, size: draw(seed, F.col("seq"), channel) % size
    return edge_log(n, vertex_id("user", pick(0, n_users)), vertex_id("item", pick(1, n_items)), F.lit("interaction"), (pick(2, 4) + 1) / 2, F.col("seq"))
