"""Queries of the file readers and of dictionary lookups, each with SQL: the tables at hand are written as files first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import bar, padded, vertex_id
from graphloom.operators import evaluation, storage
from graphloom.plans.graph_queries import FOLLOWS_SQL, LOG_SQL, VERTICES_SQL
from graphloom.plans.registry import Registry
from graphloom.runtime import load, scratch
from graphloom.sources import edges, files

REGISTRY = Registry()
query = REGISTRY.query

_TWO_WAYS = "SELECT src, dst, etype, 1.0::DOUBLE AS weight FROM {0} UNION ALL SELECT dst, src, etype, 1.0::DOUBLE FROM {0}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as profiles and what they touch, ``nota`` being made of the event's number."""
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).where(F.col("user_id").isNotNull() & F.col("k").isNotNull())
    return e.select("event_id", "event_type", F.col("user_id").alias("profile_id"), F.col("k").alias("touched"), (F.col("event_id") % 5 + 1).alias("nota"), F.col("ts").alias("inserted_at"))


_EVENTS = "x AS (SELECT event_id, event_type, user_id, props->>'$.k' AS k, event_id % 5 + 1 AS nota FROM events WHERE user_id IS NOT NULL AND (props->>'$.k') IS NOT NULL)"


def _put(spark: SparkSession, df: DataFrame, columns: tuple[str, ...], **names: str) -> str:
    path = scratch(spark, "files")
    files.write_table(df.select(*[F.col(names.get(c, c)).alias(c) if names.get(c, c) in df.columns else F.lit(None).cast("string").alias(c) for c in columns]), path, columns)
    return path


@query("read_follows", f"WITH {FOLLOWS_SQL} SELECT replace(src, 'user:', 'profile:') AS src, replace(dst, 'user:', 'profile:') AS dst, 'follow' AS etype, weight FROM log")
def read_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = edges.follows(spark, sf_dir).select(F.substring_index("src", ":", -1).alias("from_profile_id"), F.substring_index("dst", ":", -1).alias("to_profile_id"), F.col("ts").alias("inserted_at"))
    return files.follows(spark, _put(spark, f, files.FOLLOWS))


_LIKES = f"WITH {_EVENTS}, d AS (SELECT DISTINCT 'profile:' || user_id AS src, 'post:' || k AS dst, 'like' AS etype FROM x WHERE event_type = 'click') "


def _likes(spark: SparkSession, sf_dir: str) -> str:
    return _put(spark, _events(spark, sf_dir).where(F.col("event_type") == "click"), files.LIKES, post_id="touched")


@query("read_likes", _LIKES + _TWO_WAYS.format("d"))
def read_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.likes(spark, _likes(spark, sf_dir))


@query("read_likes_duplicates", f"WITH {_EVENTS} SELECT count(*) - count(DISTINCT (user_id, k)) AS duplicates FROM x WHERE event_type = 'click'")
def read_likes_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.duplicate_likes(spark, _likes(spark, sf_dir))


@query("read_posts", "SELECT trim(post_id) AS post_id, profile_id, coalesce(likes_count, 0)::BIGINT AS likes_count, coalesce(reposts_count, 0)::BIGINT AS reposts_count, category, type, inserted_at FROM posts")
def read_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.posts(spark, _put(spark, load(spark, sf_dir, "posts").withColumn("post_id", F.trim("post_id")), files.POSTS))


_RATED = f"WITH {_EVENTS}, d AS (SELECT DISTINCT 'profile:' || user_id AS src, 'professor:' || k AS dst, 'avaliou' AS etype FROM x UNION SELECT 'profile:' || user_id, 'professor:' || k, 'postou' FROM x WHERE event_type = 'purchase') "


def _ratings(spark: SparkSession, sf_dir: str) -> str:
    return _put(spark, _events(spark, sf_dir), files.RATINGS, professor_id="touched")


@query("read_professor_graph", _RATED + _TWO_WAYS.format("d"))
def read_professor_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _put(spark, _events(spark, sf_dir).where(F.col("event_type") == "purchase"), files.PROFESSOR_POSTS, professor_id="touched", post_id="event_id")
    return files.professor_graph(spark, _ratings(spark, sf_dir), posts)


@query("read_professor_interactions", f"WITH {_EVENTS}, d AS (SELECT DISTINCT 'profile:' || user_id AS src, 'professor:' || k AS dst, 'liked_professor' AS etype FROM x) " + _TWO_WAYS.format("d"))
def read_professor_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.professor_interactions(spark, _put(spark, _events(spark, sf_dir), files.PROFESSOR_LIKES, professor_id="touched"))


@query("grade_histogram", f"WITH {_EVENTS}, n AS (SELECT nota, count(*) AS ratings FROM x GROUP BY nota) SELECT nota, ratings, rpad('nota ' || nota, 8, ' ') AS label, repeat('#', CAST(ratings * 40 // max(ratings) OVER () AS INTEGER)) AS bar FROM n")
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings per grade, with a padded label and a bar of up to 40 signs."""
    per = files.professor_ratings(spark, _ratings(spark, sf_dir)).groupBy("nota").agg(F.count(F.lit(1)).alias("ratings"))
    label = padded(F.concat(F.lit("nota "), F.col("nota").cast("string")), 8)
    # a row per grade
    return per.select("nota", "ratings", label.alias("label"), bar(F.expr("ratings * 40 div max(ratings) over ()")).alias("bar"))


@query("read_professors", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS nome_professor, p_brand AS instituto, p_size::BIGINT AS nota, 0::BIGINT AS qts_avaliacao, NULL::VARCHAR AS instituto_id FROM part")
def read_professors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.professors(spark, _put(spark, load(spark, sf_dir, "part"), files.PROFESSORS, id="p_partkey", nome_professor="p_name", instituto="p_brand", nota="p_size", qts_avaliacao="p_mfgr"))


_KNOWN = """u AS (SELECT DISTINCT user_idx, profile_id FROM users WHERE profile_id IS NOT NULL), t AS (SELECT DISTINCT item_idx, tipo, db_id FROM items WHERE db_id IS NOT NULL),
i AS (SELECT user_idx, item_idx, round(weight::DOUBLE, 4) AS weight FROM interactions WHERE isfinite(weight) AND user_idx IN (SELECT user_idx FROM u) AND item_idx IN (SELECT item_idx FROM t))"""


@query("read_interaction_files", f"WITH {_KNOWN} SELECT 'profile:' || profile_id AS src, tipo || ':' || db_id AS dst, 'interaction' AS etype, weight FROM i JOIN u USING (user_idx) JOIN t USING (item_idx)")
def read_interaction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``users.tsv``, ``items.tsv`` and ``interactions.tsv`` of the rows whose user and item are known."""
    u = load(spark, sf_dir, "users").select("user_idx", "profile_id").where("profile_id IS NOT NULL").distinct()
    t = load(spark, sf_dir, "items").select("item_idx", "tipo", "db_id").where("db_id IS NOT NULL").distinct()
    i = load(spark, sf_dir, "interactions").where(F.abs("weight") < F.lit(float("inf"))).join(u, "user_idx", "left_semi").join(t, "item_idx", "left_semi")
    folder = scratch(spark, "tsv")
    weight = F.round(F.col("weight").cast("double"), 4).alias("weight")
    time = F.coalesce(F.col("inserted_at").cast("string"), F.lit("?")).alias("inserted_at")
    for df, name, columns in ((u, "users", files.USERS), (t, "items", files.ITEMS), (i.select("user_idx", "item_idx", weight, time), "interactions", files.INTERACTIONS)):
        files.write_table(df, f"{folder}/{name}.tsv", columns, "\t")
    return files.interactions(spark, folder)


@query("read_adjacency_lists", f"WITH {_EVENTS} SELECT DISTINCT 'user:' || user_id AS src, 'item:' || k AS dst, 'interacted' AS etype, 1.0::DOUBLE AS weight FROM x")
def read_adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _events(spark, sf_dir).groupBy("profile_id").agg(F.concat_ws(" ", F.collect_set("touched")).alias("touched"))
    path = scratch(spark, "lists")
    listed.select(F.concat_ws(" ", F.col("profile_id").cast("string"), "touched").alias("value")).write.text(path)
    return files.adjacency_lists(spark, path)


# ---------------------------------------------------------------- dictionary lookups, restriction to a sample

_NUMBERED = f"{LOG_SQL}, p AS (SELECT src AS id, 2 * seq AS place FROM log UNION ALL SELECT dst, 2 * seq + 1 FROM log), f AS (SELECT id, min(place) AS seen FROM p GROUP BY id), d AS (SELECT id, row_number() OVER (ORDER BY seen) - 1 AS n FROM f)"


@query("edges_encoded", f"WITH {_NUMBERED} SELECT seq, a.n AS src_id, b.n AS dst_id FROM log JOIN d a ON a.id = src JOIN d b ON b.id = dst")
def edges_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edges.activity(spark, sf_dir, numbered=True)
    numbers = storage.vertex_dictionary(log)
    return storage.encode(storage.encode(log, numbers, "src", "src_id"), numbers, "dst", "dst_id").select("seq", "src_id", "dst_id")


@query("dictionary_lookup", f"WITH {_NUMBERED}, q AS (SELECT DISTINCT 'user:' || user_idx AS id FROM users) SELECT q.id, d.n AS internal_id FROM q LEFT JOIN d ON d.id = q.id")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of all users of the interaction data in the dictionary of the events; null for those it doesn't know."""
    asked = load(spark, sf_dir, "users").select(vertex_id("user", F.col("user_idx")).alias("id")).distinct()
    return storage.encode(asked, storage.vertex_dictionary(edges.activity(spark, sf_dir, numbered=True)), "id", "internal_id").select("id", "internal_id")


@query("dictionary_reverse", f"WITH {_NUMBERED}, q AS (SELECT DISTINCT user_idx::BIGINT AS n FROM users) SELECT q.n AS internal_id, d.id FROM q LEFT JOIN d ON d.n = q.n")
def dictionary_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices that have the numbers of the users of the interaction data; null where there is none."""
    asked = load(spark, sf_dir, "users").select(F.col("user_idx").cast("long").alias("internal_id")).distinct()
    return storage.decode(asked, storage.vertex_dictionary(edges.activity(spark, sf_dir, numbered=True)), "internal_id", "id").select("internal_id", "id")


@query("edges_of_sampled_users", f"""WITH {LOG_SQL}, e AS (SELECT DISTINCT src, dst, etype, weight FROM log),
s AS (SELECT src FROM (SELECT DISTINCT src FROM e) ORDER BY ('0x' || substr(md5('42|' || src), 1, 8))::BIGINT, src LIMIT 50) SELECT src, dst, etype, weight FROM e WHERE src IN (SELECT src FROM s)""")
def edges_of_sampled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a sample of users, as an evaluation on a subgraph takes them."""
    stored = storage.stored_edges(edges.activity(spark, sf_dir))
    chosen = evaluation.sample_users(stored.select(F.col("src").alias("user")), 50)
    return stored.join(chosen.withColumnRenamed("user", "src"), "src", "left_semi").select("src", "dst", "etype", "weight")


@query("vertex_sets_equal", f"WITH {LOG_SQL}, {VERTICES_SQL} SELECT count(*) AS vertices, true AS equal FROM v")
def vertex_sets_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vertices of the log and those of its dictionary are the same set."""
    log = edges.activity(spark, sf_dir, numbered=True)
    return storage.same_set(storage.vertices(log), storage.vertex_dictionary(log).select("id")).withColumnRenamed("rows", "vertices")
