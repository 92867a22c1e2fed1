"""Queries of the graph operators over the tables at hand, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import draw, lenient_int, suffix_int, vertex_id, vertex_kind
from graphloom.operators import evaluation, lightgcn, ranking, storage, training
from graphloom.plans.registry import Registry
from graphloom.runtime import load, materialize, scratch
from graphloom.serving import live_entries
from graphloom.sources import edges as sources
from graphloom.streaming import ingest as streaming

REGISTRY = Registry()
query = REGISTRY.query

SEGMENT_EDGES = 1_000
CUTOFF = "2024-01-15 00:00:00"
WALK = 10
#: Searches ask for every user whose id is divisible by this, against all edges.
ASK_EVERY = 20

# ---------------------------------------------------------------- SQL parts

_WEIGHT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in sources.EVENT_WEIGHTS.items()) + " ELSE 1.0 END"
_LOG = f"""log AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, ts, 'user:' || user_id AS src, 'item:' || (props->>'$.k') AS dst,
         event_type AS etype, CAST({_WEIGHT} AS DOUBLE) AS weight
  FROM events WHERE user_id IS NOT NULL AND (props->>'$.k') IS NOT NULL
)"""
_E = _LOG + ", e AS (SELECT DISTINCT src, dst, etype, weight FROM log)"
_BOTH = _E + ", b AS (SELECT src, dst, etype, weight FROM e UNION SELECT dst, src, etype, weight FROM e)"
_V = "v AS (SELECT src AS id FROM log UNION SELECT dst FROM log)"
_SEGMENTS = _LOG + f""", s AS (SELECT *, (seq - 1) // {SEGMENT_EDGES} AS segment_id FROM log),
m AS (SELECT segment_id, min(ts) AS created_at, count(*) AS edge_count, segment_id = (SELECT max(segment_id) FROM s) AS active FROM s GROUP BY segment_id),
gone AS (SELECT segment_id FROM m WHERE NOT active AND created_at < TIMESTAMP '{CUTOFF}')"""
_PURCHASES = """log AS (
  SELECT 'customer:' || o_custkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS etype, 1.0::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND l_partkey IS NOT NULL
), e AS (SELECT DISTINCT src, dst, etype, weight FROM log)"""
_FOLLOWS = """f0 AS (
  SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS next_id FROM events WHERE event_type = 'signup'
), log AS (
  SELECT 'user:' || user_id AS src, 'user:' || next_id AS dst, 'follow' AS etype, 1.0::DOUBLE AS weight FROM f0 WHERE next_id IS NOT NULL AND user_id IS NOT NULL
), e AS (SELECT DISTINCT src, dst, etype, weight FROM log)"""
LOG_SQL, VERTICES_SQL, FOLLOWS_SQL = _LOG, _V, _FOLLOWS
_INTERACTIONS = """log AS (
  SELECT 'profile:' || profile_id AS src, tipo || ':' || db_id AS dst, 'interaction' AS etype, coalesce(CAST(weight AS DOUBLE), 1.0) AS weight
  FROM interactions JOIN (SELECT DISTINCT user_idx, profile_id FROM users WHERE profile_id IS NOT NULL) USING (user_idx)
  JOIN (SELECT DISTINCT item_idx, tipo, db_id FROM items WHERE db_id IS NOT NULL) USING (item_idx) WHERE weight IS NULL OR NOT isnan(weight)
), e AS (SELECT DISTINCT src, dst, etype, weight FROM log)"""
_ASKED = f"(SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE user_id % {ASK_EVERY} = 0) x(id)"
_ALL_USERS = "(SELECT DISTINCT 'user:' || user_id AS id FROM events WHERE user_id IS NOT NULL) x(id)"


def _ppr_sql(edges: str, length: int = WALK, r: float = ranking.RESET, seeds: str = _ASKED) -> str:
    """The expected visits of every seed as a chain of steps."""
    sql = f""", p AS MATERIALIZED (
  SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS p FROM {edges} GROUP BY src, dst
), outs AS MATERIALIZED (SELECT DISTINCT src FROM {edges}
), seeds AS MATERIALIZED (SELECT DISTINCT id AS seed FROM {seeds} WHERE id IN (SELECT src FROM {edges} UNION SELECT dst FROM {edges})
), p0 AS MATERIALIZED (SELECT seed, seed AS id, 1.0::DOUBLE AS mass FROM seeds)"""
    for t in range(1, length):
        q = f"p{t - 1}"
        sql += f""", p{t} AS MATERIALIZED (SELECT seed, id, sum(m) AS mass FROM (
    SELECT {q}.seed, p.dst AS id, {1 - r} * {q}.mass * p.p AS m FROM {q} JOIN p ON p.src = {q}.id
    UNION ALL SELECT seed, seed, {r} * mass FROM {q} WHERE id IN (SELECT src FROM outs)
    UNION ALL SELECT seed, seed, mass FROM {q} WHERE id NOT IN (SELECT src FROM outs)) GROUP BY seed, id)"""
    every = " UNION ALL ".join(f"SELECT * FROM p{t}" for t in range(length))
    return sql + f", visits AS (SELECT seed, id, sum(mass) AS visits FROM ({every}) GROUP BY seed, id)"


def _ppr_ranked(k: int) -> str:
    return f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(visits, 9) DESC, id) AS rank FROM visits WHERE id <> seed AND visits > 0
), kept AS (SELECT seed, id, visits / sum(visits) OVER (PARTITION BY seed) AS score, rank FROM ranked WHERE rank <= {k})"""


# ---------------------------------------------------------------- frames


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.activity(spark, sf_dir)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.stored_edges(_log(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.stored_edges(storage.both_ways(_log(spark, sf_dir).drop("ts")))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.assign_segments(sources.activity(spark, sf_dir, numbered=True), SEGMENT_EDGES)


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "events").where(F.col("user_id") % ASK_EVERY == 0)
    return asked.select(vertex_id("user", F.col("user_id")).alias("id")).distinct()


def _all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.col("user_id").isNotNull()).select(vertex_id("user", F.col("user_id")).alias("id")).distinct()


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---------------------------------------------------------------- edges, vertices, lookups


@query("edges_activity", f"WITH {_LOG} SELECT src, dst, etype, weight, epoch_us(ts) AS at_us FROM log")
def edges_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("src", "dst", "etype", "weight", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


@query("edges_purchases", f"WITH {_PURCHASES} SELECT src, dst, etype, weight FROM log")
def edges_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.purchases(spark, sf_dir).drop("ts")


@query("edges_follows", f"WITH {_FOLLOWS} SELECT src, dst, etype, weight FROM log")
def edges_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.follows(spark, sf_dir).drop("ts", "seq")


@query("edges_interactions", f"WITH {_INTERACTIONS} SELECT src, dst, etype, round(weight, 4) AS weight FROM log")
def edges_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.interactions(spark, sf_dir).drop("ts").withColumn("weight", F.round("weight", 4))


@query("edges_bidirectional", f"WITH {_LOG} SELECT src, dst, etype, weight FROM log UNION ALL SELECT dst, src, etype, weight FROM log")
def edges_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.both_ways(_log(spark, sf_dir).drop("ts"))


@query("vertices", f"WITH {_LOG}, {_V} SELECT id, split_part(id, ':', 1) AS kind, try_cast(split_part(id, ':', 2) AS BIGINT) AS number FROM v")
def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = storage.vertices(_log(spark, sf_dir))
    return v.select("id", vertex_kind(F.col("id")).alias("kind"), F.coalesce(suffix_int(F.col("id"), "user"), suffix_int(F.col("id"), "item")).alias("number"))


@query(
    "vertex_dictionary",
    f"WITH {_LOG}, f AS (SELECT id, min(at) AS seen FROM (SELECT src AS id, 2 * seq AS at FROM log UNION ALL SELECT dst, 2 * seq + 1 FROM log) GROUP BY id) SELECT id, row_number() OVER (ORDER BY seen) - 1 AS internal_id FROM f".replace(" AS at ", " AS place ").replace("min(at)", "min(place)"),
)
def vertex_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.vertex_dictionary(sources.activity(spark, sf_dir, numbered=True))


@query("edge_count", f"WITH {_LOG} SELECT count(*) AS edges FROM log")
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"))


@query("vertex_count", f"WITH {_LOG}, {_V} SELECT count(*) AS vertices FROM v")
def vertex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.vertices(_log(spark, sf_dir)).agg(F.count(F.lit(1)).alias("vertices"))


@query("bag_dedup", f"WITH {_E} SELECT src, dst, etype, weight FROM e")
def bag_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


for _direction, _here, _there in (("outgoing", "src", "dst"), ("incoming", "dst", "src")):
    for _etype in (None, "click"):
        _name = f"neighbors_{'out' if _direction == 'outgoing' else 'in'}{'_typed' if _etype else ''}"
        REGISTRY.add(
            _name,
            lambda spark, sf_dir, d=_direction, t=_etype: storage.neighbours(_log(spark, sf_dir), None, d, t),
            f"WITH {_LOG} SELECT DISTINCT {_here} AS id, {_there} AS neighbour FROM log" + (f" WHERE etype = '{_etype}'" if _etype else ""),
        )


@query("neighbors_of_seeds", f"WITH {_BOTH} SELECT DISTINCT src AS id, dst AS neighbour FROM b WHERE src IN (SELECT id FROM {_ASKED})")
def neighbors_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.neighbours(_both(spark, sf_dir), _seeds(spark, sf_dir))


# ---------------------------------------------------------------- segments


@query("segment_assign", f"WITH {_SEGMENTS} SELECT seq, src, dst, etype, weight, segment_id FROM s")
def segment_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir).select("seq", "src", "dst", "etype", "weight", "segment_id")


@query("segment_meta", f"WITH {_SEGMENTS} SELECT segment_id, epoch_us(created_at) AS created_us, edge_count, active FROM m")
def segment_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = storage.segment_meta(_segmented(spark, sf_dir))
    return meta.select("segment_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "edge_count", "active")


@query("segment_prune", f"WITH {_SEGMENTS} SELECT segment_id, edge_count FROM m WHERE segment_id IN (SELECT segment_id FROM gone)")
def segment_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = storage.segment_meta(_segmented(spark, sf_dir))
    return storage.expired_segments(meta, F.lit(CUTOFF).cast("timestamp_ntz")).select("segment_id", "edge_count")


@query("edges_after_prune", f"WITH {_SEGMENTS} SELECT DISTINCT segment_id, src, dst, etype, weight FROM s WHERE segment_id NOT IN (SELECT segment_id FROM gone)")
def edges_after_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.stored_edges(storage.live_log(_segmented(spark, sf_dir), F.lit(CUTOFF).cast("timestamp_ntz")))


@query("stream_ingest", f"WITH {_SEGMENTS} SELECT seq, src, dst, etype, weight, segment_id FROM s")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity log as a stream writes it: the events file is a stream's source, taken until it is drained."""
    events = spark.readStream.schema(load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    stream = storage.edge_log(
        events, vertex_id("user", F.col("user_id")), vertex_id("item", F.get_json_object("props", "$.k")), F.col("event_type"), sources.event_weight(), F.col("ts"), F.col("event_id")
    )
    path = scratch(spark, "stream")
    streaming.ingest(stream, path, f"{path}/checkpoint", ["ts", "event_id"], SEGMENT_EDGES, availableNow=True).awaitTermination()
    return streaming.read_log(spark, path).select("seq", "src", "dst", "etype", "weight", F.col("segment_id").cast("long").alias("segment_id"))


# ---------------------------------------------------------------- rankers


def _global_sql(head: str, k: int, prefix: str | None, least: int) -> str:
    where = f"WHERE starts_with(id, '{prefix}')" if prefix else ""
    return f"""WITH {head}, {_V}, d AS (SELECT dst AS id, count(DISTINCT src) AS degree FROM e GROUP BY dst),
c AS (SELECT v.id, coalesce(degree, 0) AS degree FROM v LEFT JOIN d ON d.id = v.id),
t AS (SELECT * FROM c {where} {'AND' if where else 'WHERE'} degree >= {least} ORDER BY degree DESC, id LIMIT {k})
SELECT id, degree, round(CASE WHEN max(degree) OVER () > 0 THEN degree::DOUBLE / max(degree) OVER () ELSE 0 END, 6) AS score,
       CAST(row_number() OVER (ORDER BY degree DESC, id) AS INTEGER) AS rank FROM t"""


for _name, _k, _prefix, _least in (("global_rank", 20, None, 1), ("global_rank_prefix", 20, "item:", 1), ("global_rank_min_degree", 50, "item:", 60), ("global_rank_zero_degree", 200, "user:", 0)):
    REGISTRY.add(
        _name,
        lambda spark, sf_dir, k=_k, p=_prefix, m=_least: _rounded(ranking.global_rank(_edges(spark, sf_dir), storage.vertices(_log(spark, sf_dir)), k, p, m), "score"),
        _global_sql(_E, _k, _prefix, _least),
    )


@query("global_rank_purchases", _global_sql(_PURCHASES, 50, "part:", 1))
def global_rank_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sources.purchases(spark, sf_dir)
    return _rounded(ranking.global_rank(storage.stored_edges(log), storage.vertices(log), 50, "part:"), "score")


@query("global_rank_interactions", _global_sql(_INTERACTIONS, 50, "post:", 1))
def global_rank_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sources.interactions(spark, sf_dir)
    return _rounded(ranking.global_rank(storage.stored_edges(log), storage.vertices(log), 50, "post:"), "score")


def _similar_sql(head: str, normalize: str, degree: str, least: int, k: int) -> str:
    item = "overlap" if degree == "overlap" else "b.n"
    score = {"raw": "overlap::DOUBLE", "jaccard": f"overlap::DOUBLE / (a.n + {item} - overlap)", "cosine": f"overlap::DOUBLE / sqrt(a.n::DOUBLE * {item})"}[normalize]
    return f"""WITH {head}, q AS (SELECT DISTINCT src, dst FROM e), n AS (SELECT dst, count(*) AS n FROM q GROUP BY dst),
o AS (SELECT x.dst AS seed, y.dst AS id, count(*) AS overlap FROM q x JOIN q y ON x.src = y.src AND x.dst <> y.dst GROUP BY 1, 2),
s AS (SELECT seed, id, overlap, {score} AS score FROM o JOIN n a ON a.dst = seed JOIN n b ON b.dst = id WHERE overlap >= {least}),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT seed, id, overlap, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


for _name, _norm, _degree, _least in (
    ("similar_raw", "raw", "overlap", 1), ("similar_jaccard", "jaccard", "overlap", 1), ("similar_cosine", "cosine", "overlap", 1),
    ("similar_jaccard_global", "jaccard", "global", 1), ("similar_cosine_global", "cosine", "global", 1), ("similar_min_overlap", "jaccard", "global", 30),
):
    REGISTRY.add(
        _name,
        lambda spark, sf_dir, n=_norm, d=_degree, m=_least: _rounded(ranking.similar_items(_edges(spark, sf_dir), None, n, d, m), "score"),
        _similar_sql(_E, _norm, _degree, _least, 20),
    )


@query("similar_purchases", _similar_sql(_PURCHASES, "cosine", "global", 2, 10))
def similar_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = storage.stored_edges(sources.purchases(spark, sf_dir))
    return _rounded(ranking.similar_items(edges, None, "cosine", "global", 2, 10), "score")


@query("transition_matrix", f"WITH {_BOTH} SELECT src, dst, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src), 6) AS p FROM b GROUP BY src, dst")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.transitions(_both(spark, sf_dir)), "p")


@query("ppr_exact", f"WITH {_BOTH}{_ppr_sql('b')}{_ppr_ranked(100)} SELECT seed, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kept")
def ppr_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.pagerank(_both(spark, sf_dir), _seeds(spark, sf_dir)), "score")


@query("ppr_visits", f"WITH {_FOLLOWS}{_ppr_sql('e')} SELECT seed, id, round(visits, 6) AS visits FROM visits")
def ppr_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.expected_visits(storage.stored_edges(sources.follows(spark, sf_dir)), _seeds(spark, sf_dir)), "visits")


def _walk_sql(seeds: str, walks: int = 1_000, steps: int = ranking.WALK_LENGTH) -> str:
    rnd = lambda t, c: f"('0x' || substr(md5('42|' || seed || '|' || walk || '|{t}|{c}'), 1, 8))::BIGINT"
    sql = f"""WITH {_BOTH}, n AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst, etype, weight) - 1 AS nth, count(*) OVER (PARTITION BY src) AS out FROM b),
w0 AS MATERIALIZED (SELECT s.id AS seed, walk, s.id AS place FROM {seeds}, range(1, {walks + 1}) r(walk) WHERE s.id IN (SELECT src FROM b))"""
    for t in range(1, steps):
        sql += f""", w{t} AS MATERIALIZED (SELECT seed, walk, coalesce(n.dst, seed) AS place FROM (
  SELECT w.seed, w.walk, w.place, CASE WHEN {rnd(t, 0)} >= {int(ranking.RESET * 2**32)} THEN {rnd(t, 1)} % o.out END AS pick
  FROM w{t - 1} w LEFT JOIN (SELECT DISTINCT src, out FROM n) o ON o.src = w.place) c LEFT JOIN n ON n.src = c.place AND n.nth = c.pick)"""
    every = " UNION ALL ".join(f"SELECT * FROM w{t}" for t in range(steps))
    return sql + f" SELECT seed, place AS id, count(*)::DOUBLE AS visits FROM ({every}) GROUP BY ALL"


@query("ppr_monte_carlo", _walk_sql(_ASKED.replace(" x(id)", " s(id)")))
def ppr_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.simulated_visits(_both(spark, sf_dir), _seeds(spark, sf_dir))


@query("circle_of_trust", f"WITH {_BOTH}{_ppr_sql('b')}{_ppr_ranked(100)} SELECT seed, id FROM kept")
def circle_of_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.circle_of_trust(_both(spark, sf_dir), _seeds(spark, sf_dir))


_LINKS = """,
hubs AS MATERIALIZED (SELECT seed, id AS hub, 1.0::DOUBLE / count(*) OVER (PARTITION BY seed) AS share FROM kept),
rows AS MATERIALIZED (SELECT src, dst, count(*) AS n, sum(count(*)) OVER (PARTITION BY src) AS out FROM b GROUP BY src, dst),
links AS MATERIALIZED (SELECT seed, hub, share, dst, n, out FROM hubs JOIN rows ON src = hub),
a1 AS MATERIALIZED (SELECT seed, dst, sum(share * n / out) AS score FROM links GROUP BY seed, dst),
got AS MATERIALIZED (SELECT seed, dst, sum(n) AS n FROM links GROUP BY seed, dst)"""
_SALSA = f"WITH {_BOTH}{_ppr_sql('b')}{_ppr_ranked(100)}" + _LINKS


def _salsa_end(last: str) -> str:
    return f""", f AS (SELECT seed, dst AS id, score, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, dst) AS rank
  FROM {last} x WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.seed = x.seed AND k.id = x.dst))
SELECT seed, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 20"""


@query("salsa", _SALSA + _salsa_end("a1"))
def salsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.salsa(_both(spark, sf_dir), _seeds(spark, sf_dir)), "score")


def _feedback_sql(iterations: int, sql: str) -> str:
    for k in range(2, iterations + 1):
        sql += f""", h{k} AS MATERIALIZED (SELECT l.seed, l.hub, sum(a.score * l.n / g.n) AS share FROM links l
  JOIN a{k - 1} a ON a.seed = l.seed AND a.dst = l.dst JOIN got g ON g.seed = l.seed AND g.dst = l.dst GROUP BY 1, 2),
a{k} AS MATERIALIZED (SELECT l.seed, l.dst, sum(h.share * l.n / l.out) AS score FROM links l JOIN h{k} h ON h.seed = l.seed AND h.hub = l.hub GROUP BY 1, 2)"""
    return sql + _salsa_end(f"a{iterations}")


# every user of the events as a seed, with the operators' defaults
_WALK_ALL = f"WITH {_BOTH}{_ppr_sql('b', seeds=_ALL_USERS)}{_ppr_ranked(100)}"


@query("salsa_feedback", _feedback_sql(5, _WALK_ALL + _LINKS))
def salsa_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.salsa(_both(spark, sf_dir), _all_users(spark, sf_dir), feedback=True), "score")


@query("neighbors_of_all_users", f"WITH {_BOTH} SELECT DISTINCT src AS id, dst AS neighbour FROM b WHERE src IN (SELECT id FROM {_ALL_USERS})")
def neighbors_of_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.neighbours(_both(spark, sf_dir), _all_users(spark, sf_dir))


@query("ppr_exact_all_users", f"{_WALK_ALL} SELECT seed, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM kept")
def ppr_exact_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.pagerank(_both(spark, sf_dir), _all_users(spark, sf_dir)), "score")


@query("ppr_visits_all_users", f"WITH {_FOLLOWS}{_ppr_sql('e', seeds=_ALL_USERS)} SELECT seed, id, round(visits, 6) AS visits FROM visits")
def ppr_visits_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.expected_visits(storage.stored_edges(sources.follows(spark, sf_dir)), _all_users(spark, sf_dir)), "visits")


@query("ppr_monte_carlo_all_users", _walk_sql(_ALL_USERS.replace(" x(id)", " s(id)")))
def ppr_monte_carlo_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.simulated_visits(_both(spark, sf_dir), _all_users(spark, sf_dir))


@query("circle_of_trust_all_users", f"{_WALK_ALL} SELECT seed, id FROM kept")
def circle_of_trust_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.circle_of_trust(_both(spark, sf_dir), _all_users(spark, sf_dir))


@query("salsa_all_users", _WALK_ALL + _LINKS + _salsa_end("a1"))
def salsa_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.salsa(_both(spark, sf_dir), _all_users(spark, sf_dir)), "score")


@query("salsa_feedback_all_users", _feedback_sql(5, _WALK_ALL + _LINKS))
def salsa_feedback_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranking.salsa(_both(spark, sf_dir), _all_users(spark, sf_dir), feedback=True), "score")


# ---------------------------------------------------------------- embeddings

_PAIRS = _E + ", w AS (SELECT src AS \"user\", dst AS item, sum(weight) AS weight FROM e GROUP BY 1, 2)"
_ADJ = _PAIRS + """, a AS (SELECT "user" AS row, item AS col, weight AS w FROM w UNION ALL SELECT item, "user", weight FROM w),
deg AS (SELECT row AS id, sum(w) AS degree FROM a GROUP BY 1),
sc AS (SELECT id, CASE WHEN degree > 0 THEN 1 / sqrt(greatest(degree, 1)) ELSE 0 END AS s FROM deg),
adj AS MATERIALIZED (SELECT a.row, a.col, a.w * x.s * y.s AS w FROM a JOIN sc x ON x.id = a.row JOIN sc y ON y.id = a.col)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lightgcn.weighted_pairs(_edges(spark, sf_dir), "user:")


@query(
    "lightgcn_row_index",
    f"WITH {_LOG}, {_V}, n AS (SELECT id, CASE WHEN starts_with(id, 'user:') THEN 'user' ELSE 'item' END AS side FROM v) SELECT id, side, row_number() OVER (ORDER BY side = 'item', id) - 1 AS row FROM n",
)
def lightgcn_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lightgcn.row_index(storage.vertices(_log(spark, sf_dir)), "user:")


@query("weighted_pairs", f'WITH {_PAIRS} SELECT "user", item, round(weight, 6) AS weight FROM w')
def weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pairs(spark, sf_dir), "weight")


@query("weighted_degree", f"WITH {_ADJ} SELECT id, round(degree, 6) AS degree FROM deg")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lightgcn.weighted_degrees(lightgcn.symmetric(_pairs(spark, sf_dir))), "degree")


@query("adj_normalized", f"WITH {_ADJ} SELECT row, col, round(w, 6) AS w FROM adj")
def adj_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lightgcn.normalized_adjacency(_pairs(spark, sf_dir)), "w")


DEFAULTS = training.TrainingOptions()


def _e0(spark: SparkSession, sf_dir: str, dim: int = DEFAULTS.embedding_dim) -> DataFrame:
    """Embeddings that depend on the vertex's name alone."""
    d = F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))
    named = storage.vertices(_log(spark, sf_dir)).select("id", d.alias("d"))
    return named.withColumn("x", draw(F.col("id"), F.col("d")) / float(2**32) - 0.5)


def _propagate_sql(layers: int, dim: int = DEFAULTS.embedding_dim) -> str:
    sql = f"""WITH {_ADJ}, {_V}, t0 AS MATERIALIZED (SELECT id, d, ('0x' || substr(md5(id || '|' || d), 1, 8))::BIGINT / 4294967296.0 - 0.5 AS x FROM v, range(0, {dim}) r(d))"""
    for k in range(1, layers + 1):
        sql += f", t{k} AS MATERIALIZED (SELECT adj.row AS id, d, sum(w * x) AS x FROM adj JOIN t{k - 1} ON id = col GROUP BY 1, 2)"
    every = " UNION ALL ".join(f"SELECT id, d, x FROM t{k}" for k in range(layers + 1))
    return sql + f" SELECT id, CAST(d AS INTEGER) AS d, round(sum(x) / {layers + 1}, 6) AS x FROM ({every}) GROUP BY id, d"


for _name, _layers in (("propagate_1", 1), ("propagate_k", DEFAULTS.layers)):
    REGISTRY.add(
        _name,
        lambda spark, sf_dir, k=_layers: _rounded(lightgcn.propagate(_e0(spark, sf_dir), lightgcn.normalized_adjacency(_pairs(spark, sf_dir)), k), "x"),
        _propagate_sql(_layers),
    )


_VECTORS = """u AS (SELECT 'user:' || vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5),
i AS (SELECT 'item:' || vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE label >= 5),
s AS (SELECT u.id AS "user", i.id AS item, round(list_dot_product(u.v, i.v), 6) AS score FROM u, i)"""
_SEEN = """, seen AS (SELECT 'user:' || a.vec_id AS "user", 'item:' || b.vec_id AS item FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.label < 5 AND b.label >= 5)"""


def _score_sql(k: int, anti: bool) -> str:
    where = "WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.\"user\" = s.\"user\" AND seen.item = s.item)" if anti else ""
    return f"""WITH {_VECTORS}{_SEEN if anti else ''}, r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM s {where})
SELECT "user", item, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = load(spark, sf_dir, "embeddings")
    users, items = e.where(F.col("label") < 5), e.where(F.col("label") >= 5)
    return tuple(x.select(vertex_id(kind, F.col("vec_id")).alias("id"), F.col("embedding").alias("v")) for x, kind in ((users, "user"), (items, "item")))


@query("embed_topk", _score_sql(20, False))
def embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lightgcn.score_top_k(*_sides(spark, sf_dir), 20)


@query("embed_topk_exclude_seen", _score_sql(20, True))
def embed_topk_exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    after = e.where(F.col("label") >= 5).select((F.col("vec_id") - 1).alias("vec_id"), vertex_id("item", F.col("vec_id")).alias("item"))
    seen = e.where(F.col("label") < 5).join(after, "vec_id").select(vertex_id("user", F.col("vec_id")).alias("user"), "item")
    return lightgcn.score_top_k(*_sides(spark, sf_dir), 20, seen)


#: The defaults, and more steps where 1,024,000 draws would be fewer than five a pair.
TRAINING = training.TrainingOptions(draws_per_pair=5)


@query("lightgcn_train")
def lightgcn_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings trained on the activity graph."""
    return training.train(_edges(spark, sf_dir), storage.vertices(_log(spark, sf_dir)), "user:", TRAINING)


@query(
    "lightgcn_checks",
    f"WITH {_LOG}, {_V} SELECT id, CASE WHEN starts_with(id, 'user:') THEN 'user' ELSE 'item' END AS side, {DEFAULTS.embedding_dim} AS dimensions, true AS finite FROM v",
)
def lightgcn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of ``lightgcn_train``: every vertex has a vector of finite numbers, on its side."""
    finite = F.forall("v", lambda x: F.abs(x) < F.lit(float("inf")))
    return lightgcn_train(spark, sf_dir).select("id", "side", F.size("v").alias("dimensions"), finite.alias("finite"))


@query("lightgcn_recommend")
def lightgcn_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best unseen items of every user by embeddings trained on the activity graph."""
    model = materialize(lightgcn_train(spark, sf_dir), "model")
    users, items = (model.where(F.col("side") == side).select("id", "v") for side in ("user", "item"))
    seen = _edges(spark, sf_dir).select(F.col("src").alias("user"), F.col("dst").alias("item")).distinct()
    return lightgcn.score_top_k(users, items, 10, seen)


# ---------------------------------------------------------------- evaluation

_SPLIT = f"""{_E}, q AS (SELECT DISTINCT src AS "user", dst AS item FROM e),
h AS (SELECT *, ('0x' || substr(md5('42|' || "user" || '|' || item), 1, 8))::BIGINT < {int(0.2 * 2**32)} AS held FROM q),
train AS MATERIALIZED (SELECT "user", item FROM h WHERE NOT held), test AS MATERIALIZED (SELECT "user", item FROM h WHERE held)"""
_METRICS = f"""WITH {_SPLIT}, pop AS (SELECT item, count(*) AS n FROM train GROUP BY item),
us AS (SELECT DISTINCT "user" FROM test),
c AS (SELECT us."user", pop.item, row_number() OVER (PARTITION BY us."user" ORDER BY n DESC, pop.item) AS rank FROM us, pop
      WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = us."user" AND t.item = pop.item)),
g AS (SELECT "user", count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM c JOIN test USING ("user", item) WHERE rank <= 20 GROUP BY 1),
z AS (SELECT "user", count(*) AS n FROM test GROUP BY 1),
pu AS (SELECT z."user", coalesce(hits, 0)::DOUBLE / n AS recall, coalesce(hits, 0) / 20.0::DOUBLE AS precision,
             coalesce(dcg, 0) / (SELECT sum(1 / log2(k + 1)) FROM range(1, 21) r(k) WHERE k <= z.n) AS ndcg FROM z LEFT JOIN g USING ("user"))"""


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training pairs, test pairs, ranking): the most popular items of the training data that a user hasn't had."""
    train, test = evaluation.split(_edges(spark, sf_dir).select(F.col("src").alias("user"), F.col("dst").alias("item")))
    return train, test, evaluation.popular_unseen(train, test, 20)


@query("train_test_split", f'WITH {_SPLIT} SELECT "user", item, held FROM h')
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluation.split(_edges(spark, sf_dir).select(F.col("src").alias("user"), F.col("dst").alias("item")))
    return train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)))


@query("eval_metrics", _METRICS + ' SELECT count(*) AS users, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(ndcg), 6) AS ndcg FROM pu')
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, ranking_ = _evaluated(spark, sf_dir)
    return _rounded(evaluation.mean_metrics(evaluation.per_user_metrics(ranking_, evaluation.truth(test, train), 20)), "recall", "precision", "ndcg")


@query(
    "random_baseline",
    f"""WITH {_SPLIT}, m AS (SELECT count(DISTINCT item) AS n FROM train), k AS (SELECT "user", count(*) AS n FROM train GROUP BY 1)
SELECT round(avg(least(20.0::DOUBLE / greatest(m.n - coalesce(k.n, 0), 1), 1)), 6) AS baseline FROM (SELECT DISTINCT "user" FROM test) LEFT JOIN k USING ("user"), m""",
)
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = evaluation.split(_edges(spark, sf_dir).select(F.col("src").alias("user"), F.col("dst").alias("item")))
    return _rounded(evaluation.random_baseline(train, evaluation.truth(test, train), 20), "baseline")


@query("eval_lightgcn")
def eval_lightgcn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings trained on the training pairs, judged by the held-out ones beside a ranking by chance; ``uplift`` is recall / baseline."""
    edges = _edges(spark, sf_dir)
    train, test = evaluation.split(edges.select(F.col("src").alias("user"), F.col("dst").alias("item")))
    kept = materialize(edges.join(train.select(F.col("user").alias("src"), F.col("item").alias("dst")), ["src", "dst"], "left_semi"), "train-edges")
    model = materialize(training.train(kept, storage.vertices(kept), "user:", TRAINING), "model")
    users, items = (model.where(F.col("side") == side).select("id", "v") for side in ("user", "item"))
    relevant = evaluation.truth(test, train)
    found = evaluation.mean_metrics(evaluation.per_user_metrics(lightgcn.score_top_k(users, items, 20, train), relevant, 20))
    both = found.crossJoin(evaluation.random_baseline(train, relevant, 20))  # one row each
    return _rounded(both.withColumn("uplift", F.try_divide("recall", "baseline")), "recall", "precision", "ndcg", "baseline", "uplift")


@query("sample_users", f"""WITH {_E}, u AS (SELECT DISTINCT src AS "user" FROM e) SELECT "user" FROM u ORDER BY ('0x' || substr(md5('42|' || "user"), 1, 8))::BIGINT, "user" LIMIT 50""")
def sample_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.sample_users(_edges(spark, sf_dir).select(F.col("src").alias("user")), 50)


# ---------------------------------------------------------------- statistics


@query("likes_distribution", f"WITH {_E}, n AS (SELECT dst, count(DISTINCT src) AS likes FROM e GROUP BY dst) SELECT likes, count(*) AS items FROM n GROUP BY likes")
def likes_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_item = _edges(spark, sf_dir).groupBy("dst").agg(F.countDistinct("src").alias("likes"))
    return per_item.groupBy("likes").agg(F.count(F.lit(1)).alias("items"))


@query("long_tail", f"WITH {_PURCHASES}, n AS (SELECT dst, count(DISTINCT src) AS buyers FROM e GROUP BY dst) SELECT count(*) AS parts, count(*) FILTER (buyers <= 25) AS tail FROM n")
def long_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_part = storage.stored_edges(sources.purchases(spark, sf_dir)).groupBy("dst").agg(F.countDistinct("src").alias("buyers"))
    return per_part.agg(F.count(F.lit(1)).alias("parts"), F.count(F.when(F.col("buyers") <= 25, 1)).alias("tail"))


@query("mutual_follows", f"WITH {_FOLLOWS}, q AS (SELECT DISTINCT src, dst FROM e) SELECT x.src AS a, x.dst AS b FROM q x JOIN q y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def mutual_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.mutual(sources.follows(spark, sf_dir))


@query("most_active", f"WITH {_LOG} SELECT src AS id, count(*) AS edges FROM log GROUP BY src ORDER BY edges DESC, id LIMIT 1")
def most_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("edges")).orderBy(F.col("edges").desc(), "id").limit(1)


@query("type_composition", f"WITH {_LOG} SELECT etype, count(*) AS edges, count(DISTINCT src) AS users, round(sum(weight), 6) AS weight FROM log GROUP BY etype")
def type_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).groupBy("etype").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("users"), F.round(F.sum("weight"), 6).alias("weight"))


_ENTRIES = "SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS expires_at FROM orders"


@query("cache_live_entries", f"WITH c AS ({_ENTRIES}) SELECT key, expires_at IS NULL AS forever FROM c WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1996-01-01'")
def cache_live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("expires_at")
    )
    return live_entries(entries, F.lit("1996-01-01").cast("timestamp_ntz")).select("key", F.col("expires_at").isNull().alias("forever"))


@query(
    "metadata_enrichment",
    f"""WITH {_PURCHASES}, d AS (SELECT dst AS id, count(DISTINCT src) AS buyers FROM e GROUP BY dst)
SELECT d.id, buyers, coalesce(p_name, '?') AS name FROM d LEFT JOIN part ON 'part:' || p_partkey = d.id""",
)
def metadata_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = storage.stored_edges(sources.purchases(spark, sf_dir)).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("buyers"))
    names = load(spark, sf_dir, "part").select(vertex_id("part", F.col("p_partkey")).alias("id"), "p_name")
    return d.join(names, "id", "left").select("id", "buyers", F.coalesce("p_name", F.lit("?")).alias("name"))


@query("lenient_post_counts", "SELECT try_cast(trim(post_id) AS BIGINT) AS post_id, coalesce(max(likes_count), 0)::BIGINT AS likes, coalesce(max(reposts_count), 0)::BIGINT AS reposts FROM posts GROUP BY 1")
def lenient_post_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "posts").select(lenient_int(F.trim("post_id")).alias("post_id"), *[lenient_int(F.col(c).cast("string")).alias(n) for c, n in (("likes_count", "likes"), ("reposts_count", "reposts"))])
    return p.groupBy("post_id").agg(F.max("likes").alias("likes"), F.max("reposts").alias("reposts"))


@query(
    "dataset_stats",
    f"""WITH {_LOG}, x AS (SELECT 'orders' AS source, 'customer:' || o_custkey AS id FROM orders UNION ALL SELECT 'events', src FROM log)
SELECT count(DISTINCT id) AS ids, count(DISTINCT CASE WHEN source = 'orders' THEN id END) AS customers, count(DISTINCT CASE WHEN source = 'events' THEN id END) AS users, count(*) AS rows FROM x""",
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), vertex_id("customer", F.col("o_custkey")).alias("id"))
    both = customers.unionByName(_log(spark, sf_dir).select(F.lit("events").alias("source"), F.col("src").alias("id")))
    of = lambda s: F.countDistinct(F.when(F.col("source") == s, F.col("id")))
    return both.agg(F.countDistinct("id").alias("ids"), of("orders").alias("customers"), of("events").alias("users"), F.count(F.lit(1)).alias("rows"))
