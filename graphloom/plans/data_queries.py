"""Queries of the general data problems: failed lines, orphan references, heavy keys and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import references as refs
from graphloom.operators import sessions, skew
from graphloom.plans.registry import Registry
from graphloom.runtime import load, scratch
from graphloom.sources import strict_load

REGISTRY = Registry()
query = REGISTRY.query

HEAVY_SHARE = 0.02
GAP_SECONDS = 1800

# ---------------------------------------------------------------- problem 2

_P2_RECORDS = r"""
WITH rec AS (
  SELECT line_id, batch, regexp_replace(raw_line, '[ \t\r]+$', '') AS line FROM interactions_raw WHERE line_no <> 1
), form AS (
  SELECT *, regexp_full_match(line, '("-?[0-9]+"|-?[0-9]+)\t("-?[0-9]+"|-?[0-9]+)\t("-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"|-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?)\t("[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,6})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?"|[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,6})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)') AS ok,
         replace(line, '"', '') AS bare
  FROM rec WHERE line <> ''
), parsed AS (
  SELECT line_id, batch, ok,
         CASE WHEN ok THEN try_cast(split_part(bare, chr(9), 1) AS INTEGER) END AS user_idx,
         CASE WHEN ok THEN try_cast(split_part(bare, chr(9), 2) AS INTEGER) END AS item_idx,
         CASE WHEN ok THEN try_cast(split_part(bare, chr(9), 3) AS DOUBLE) END AS weight,
         CASE WHEN ok THEN try_cast(substr(split_part(bare, chr(9), 4), 1, 10) AS DATE) END AS day,
         CASE WHEN ok THEN split_part(bare, chr(9), 4) END AS clock
  FROM form
), judged AS (
  SELECT *, coalesce(ok AND user_idx IS NOT NULL AND item_idx IS NOT NULL AND isfinite(weight) AND day IS NOT NULL
                     AND substr(clock, 1, 4) <> '0000', false) AS valid
  FROM parsed
)
"""


@query("p2_found", _P2_RECORDS + "SELECT line_id FROM judged WHERE NOT valid")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.rejected_offsets(load(spark, sf_dir, "interactions_raw"))


@query(
    "p2_loaded",
    _P2_RECORDS
    + r"""
SELECT line_id, user_idx, item_idx, round(weight, 6) AS weight,
       epoch_us(CAST(substr(clock, 1, 10) || ' ' || substr(clock, 12, 8) || rpad(CASE WHEN regexp_extract(clock, '\.[0-9]+') = '' THEN '.' ELSE regexp_extract(clock, '\.[0-9]+') END, 7, '0') AS TIMESTAMP))
         - CASE WHEN regexp_extract(clock, '[+-][0-9]{2}:[0-9]{2}$') = '' THEN 0 ELSE
             (CASE WHEN substr(right(clock, 6), 1, 1) = '-' THEN -1 ELSE 1 END)
             * (CAST(substr(right(clock, 5), 1, 2) AS BIGINT) * 60 + CAST(right(clock, 2) AS BIGINT)) * 60000000 END AS at_us
FROM judged WHERE valid""",
)
def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = strict_load.strict_load(load(spark, sf_dir, "interactions_raw"))
    return good.select("line_id", "user_idx", "item_idx", F.round("weight", 6).alias("weight"), F.unix_micros("inserted_at").alias("at_us"))


@query(
    "p2_rejects",
    _P2_RECORDS
    + r"""
, bad AS (SELECT line_id, rec.batch, i.line_no, rec.line FROM rec JOIN judged USING (line_id) JOIN interactions_raw i USING (line_id) WHERE NOT valid
), told AS (
  SELECT *, regexp_full_match(line, '("([^"]|"")*"|[^\t"]*)(\t("([^"]|"")*"|[^\t"]*))*', 's') AS well_quoted,
         list_transform(regexp_extract_all(line || chr(9), '("(?:[^"]|"")*"|[^\t"]*)\t', 1), lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END) AS f
  FROM bad
)
SELECT line_id, batch, line_no, CASE
  WHEN NOT well_quoted THEN 'quoting' WHEN len(f) <> 4 THEN 'columns'
  WHEN NOT regexp_full_match(f[1], '-?[0-9]+') OR try_cast(f[1] AS INTEGER) IS NULL THEN 'user_idx'
  WHEN NOT regexp_full_match(f[2], '-?[0-9]+') OR try_cast(f[2] AS INTEGER) IS NULL THEN 'item_idx'
  WHEN NOT regexp_full_match(f[3], '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') OR NOT coalesce(isfinite(try_cast(f[3] AS DOUBLE)), false) THEN 'weight'
  ELSE 'inserted_at' END AS reason
FROM told""",
)
def p2_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.rejects(load(spark, sf_dir, "interactions_raw")).select("line_id", "batch", "line_no", "reason")


@query("p2_per_batch", _P2_RECORDS + "SELECT batch, count(*) FILTER (NOT valid) AS failed FROM judged GROUP BY batch HAVING count(*) FILTER (NOT valid) > 0")
def p2_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.rejects(load(spark, sf_dir, "interactions_raw")).groupBy("batch").agg(F.count(F.lit(1)).alias("failed"))


# ---------------------------------------------------------------- problem 3


def _utc(text: str) -> F.Column:
    """A date and time in UTC given as text; null if it can't be read."""
    clean = F.regexp_replace(F.trim(F.col(text)), "T", " ")
    return F.when(clean.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:.]+$"), F.concat(clean, F.lit("Z"))).try_cast("timestamp")


def reference_tables(spark: SparkSession, sf_dir: str) -> tuple[list[refs.References], list[DataFrame]]:
    """The four references of the interaction data and the tables they point into."""
    c = F.col
    i, u, t = (load(spark, sf_dir, x) for x in ("interactions", "users", "items"))
    space = F.when(c("tipo").isin("post", "review"), "posts").when(c("tipo") == "ad", "ads")
    users = u.select("user_idx", "profile_id", "created_at").distinct()
    items = t.select("item_idx", "tipo", "db_id", "created_at").distinct()
    pointing = [
        refs.references("interactions.user_idx", i, c("interaction_id"), F.lit("users"), c("user_idx"), c("inserted_at")),
        refs.references("interactions.item_idx", i, c("interaction_id"), F.lit("items"), c("item_idx"), c("inserted_at")),
        refs.references("users.profile_id", users, c("user_idx"), F.lit("profiles"), c("profile_id"), c("created_at")),
        refs.references("items.db_id", items, c("item_idx"), space, c("db_id"), c("created_at")),
    ]
    p, a, r = (load(spark, sf_dir, x) for x in ("posts", "ads", "profiles"))
    targets = [
        refs.records("users", u, c("user_idx"), c("created_at"), c("deleted_at")),
        refs.records("items", t, c("item_idx"), c("created_at"), c("deleted_at")),
        refs.records("profiles", r, c("profile_id"), c("created_at"), c("deleted_at")),
        refs.records("posts", p, F.trim(c("post_id")).try_cast("long"), _utc("inserted_at"), c("deleted_at")),
        refs.records("ads", a, c("ad_id"), c("created_at"), c("deleted_at")),
    ]
    return pointing, targets


_P3_CASES = """
WITH t AS (
  SELECT 'users' AS space, user_idx AS key, created_at::timestamptz AS born, deleted_at::timestamptz AS died FROM users
  UNION SELECT 'items', item_idx, created_at, deleted_at FROM items
  UNION SELECT 'profiles', profile_id, created_at, deleted_at FROM profiles
  UNION SELECT 'posts', try_cast(trim(post_id) AS INTEGER), (replace(trim(inserted_at), 'T', ' ') || '+00')::timestamptz, deleted_at FROM posts
  UNION SELECT 'ads', ad_id, created_at, deleted_at FROM ads
), r AS (
  SELECT 'interactions.user_idx' AS ref_field, interaction_id AS row_id, 'users' AS space, user_idx AS key, inserted_at::timestamptz AS seen FROM interactions
  UNION ALL SELECT 'interactions.item_idx', interaction_id, 'items', item_idx, inserted_at FROM interactions
  UNION SELECT 'users.profile_id', user_idx, 'profiles', profile_id, created_at FROM users
  UNION SELECT 'items.db_id', item_idx, CASE WHEN tipo = 'ad' THEN 'ads' ELSE 'posts' END, db_id, created_at FROM items
), cases AS (
  SELECT r.*, t.key IS NULL AS missing, coalesce(r.seen < t.born, false) AS early
  FROM r LEFT JOIN t ON r.space = t.space AND r.key = t.key
  WHERE r.key IS NOT NULL AND (t.key IS NULL OR r.seen < t.born OR r.seen >= t.died)
)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[DataFrame]]:
    pointing, targets = reference_tables(spark, sf_dir)
    return refs.orphan_rows(pointing, targets), targets


@query("p3_found", _P3_CASES + "SELECT DISTINCT ref_field, row_id::BIGINT AS row_id FROM cases")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)[0].select("ref_field", "row_id")


@query(
    "p3_report",
    _P3_CASES
    + """
SELECT ref_field, coalesce(strftime(seen AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period,
       CASE WHEN missing THEN 'missing' WHEN early THEN 'early' ELSE 'gone' END AS reason, count(*) AS n
FROM cases GROUP BY ALL""",
)
def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orphans, targets = _orphans(spark, sf_dir)
    return refs.orphan_report(orphans, targets)


@query(
    "p3_current",
    _P3_CASES
    + """
, n AS (SELECT space, key, count(*) AS refs FROM r WHERE key IS NOT NULL GROUP BY ALL)
SELECT n.space, n.key::BIGINT AS key, n.refs FROM n
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.space = n.space AND t.key = n.key AND t.died IS NULL)""",
)
def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphan keys after all changes, with the ledger brought forward in two batches of deltas, before and from 2024 on."""
    pointing, targets = reference_tables(spark, sf_dir)
    ledger = refs.Ledger(spark, scratch(spark, "ledger"))
    changes = (refs.reference_deltas(pointing), refs.existence_deltas(refs.united(targets)))
    later = F.coalesce(F.col("at_us") >= 1_704_067_200_000_000, F.lit(False))
    for batch, part in enumerate((~later, later)):
        ledger.apply(batch, *[deltas.where(part) for deltas in changes])
    return ledger.current_orphans()


# ---------------------------------------------------------------- problem 5


@query("p5_found", f"SELECT item_idx FROM interactions WHERE item_idx IS NOT NULL GROUP BY 1 HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM interactions)")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(load(spark, sf_dir, "interactions"), "item_idx", HEAVY_SHARE).select("item_idx")


@query(
    "p5_item_stats",
    """
SELECT item_idx, count(*) AS rows, count(DISTINCT user_idx) AS users,
       CAST(sum(CASE WHEN isfinite(weight) AND abs(weight) < 1e20 THEN CAST(weight AS DECIMAL(27, 6)) END) AS DOUBLE) AS total_weight
FROM interactions WHERE item_idx IS NOT NULL GROUP BY 1""",
)
def p5_item_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = skew.per_key_stats(load(spark, sf_dir, "interactions"), "item_idx", "user_idx", "weight")
    return out.withColumnsRenamed({"members": "users", "total": "total_weight"})


@query("p5_left_out", "SELECT item_idx, count(*) FILTER (NOT isnan(weight) AND abs(weight) >= 1e20) AS left_out FROM interactions WHERE item_idx IS NOT NULL GROUP BY 1")
def p5_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights that ``p5_item_stats`` leaves out of each item's total."""
    return skew.per_key_stats(load(spark, sf_dir, "interactions"), "item_idx", "user_idx", "weight", tell_left_out=True).select("item_idx", "left_out")


# ---------------------------------------------------------------- problem 6

_P6_SESSIONS = f"""
WITH r AS (
  SELECT user_idx, epoch_us(inserted_at) AS us FROM interactions WHERE user_idx IS NOT NULL AND inserted_at IS NOT NULL
), o AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_idx ORDER BY us) <= {GAP_SECONDS}000000 THEN 0 ELSE 1 END AS opens FROM r
), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_idx ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM o
)
"""


@query("p6_found", _P6_SESSIONS + "SELECT user_idx, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY user_idx, session")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(load(spark, sf_dir, "interactions"), "user_idx", "inserted_at", GAP_SECONDS).select("user_idx", "start_us", "end_us")


@query(
    "p6_sessions",
    _P6_SESSIONS + "SELECT user_idx, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS n_events FROM s GROUP BY user_idx, session",
)
def p6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(load(spark, sf_dir, "interactions"), "user_idx", "inserted_at", GAP_SECONDS)
