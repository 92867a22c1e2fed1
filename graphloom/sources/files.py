"""Readers of the file formats the engine takes, and their edges. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.scalar import lenient_int, strict_int, vertex_id
from graphloom.operators.storage import both_ways, edge_log

# The columns of each file, all read as text.
FOLLOWS = ("from_profile_id", "to_profile_id", "inserted_at")
LIKES = ("profile_id", "post_id")
POSTS = ("post_id", "profile_id", "likes_count", "reposts_count", "category", "type", "inserted_at")
RATINGS = ("profile_id", "professor_id", "nota", "inserted_at")
PROFESSOR_POSTS = ("profile_id", "professor_id", "post_id", "likes_count", "type", "inserted_at")
PROFESSOR_LIKES = ("profile_id", "professor_id")
PROFESSORS = ("id", "nome_professor", "instituto", "nota", "qts_avaliacao", "instituto_id")
USERS, ITEMS, INTERACTIONS = ("user_idx", "profile_id"), ("item_idx", "tipo", "db_id"), ("user_idx", "item_idx", "weight", "inserted_at")


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...], sep: str = ",") -> DataFrame:
    """A file with a header line, by name; columns it lacks are null."""
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=False)
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_table(df: DataFrame, path: str, columns: tuple[str, ...], sep: str = ",") -> None:
    """``df`` as text files with a header line each, as ``read_table`` and ``read_tsv`` take them; nulls are empty."""
    out = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).write
    out.csv(path, sep=sep, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    """(``line``): the lines of text files without the first of each, white space at their ends and blank ones."""
    # no text holds this separator, so a line is one field and the reader leaves out the first line of every file
    lines = spark.read.schema("line string").csv(path, sep="\x01", header=True, enforceSchema=True, quote="", escape="", multiLine=False)
    return lines.select(F.regexp_replace("line", r"\s+\z", "").alias("line")).where(F.length("line") > 0)


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A tab-separated file by place: first line skipped, blank lines dropped, trailing white space trimmed.

    A line with another number of columns is an error, raised when the rows are computed.
    """
    fields = F.split("line", "\t", -1)
    wrong = F.raise_error(F.concat(F.lit(f"not {len(columns)} columns: "), F.col("line"))).cast("array<string>")
    whole = F.when(F.size(fields) == len(columns), fields).otherwise(wrong)
    rows = _data_lines(spark, path).select(F.inline(F.array(F.struct(whole.alias("fields")))))
    return rows.select(*[F.get("fields", k).alias(c) for k, c in enumerate(columns)])


def follows(spark: SparkSession, path: str) -> DataFrame:
    """profile -> profile; repeated rows stay."""
    return edge_log(read_table(spark, path, FOLLOWS), vertex_id("profile", F.col("from_profile_id")), vertex_id("profile", F.col("to_profile_id")), F.lit("follow"), F.lit(1.0))


def _pairs_both_ways(rows: DataFrame, target: str, kind: str, etype: str) -> DataFrame:
    log = edge_log(rows.dropDuplicates(["profile_id", target]), vertex_id("profile", F.col("profile_id")), vertex_id(kind, F.col(target)), F.lit(etype), F.lit(1.0))
    return both_ways(log)


def likes(spark: SparkSession, path: str) -> DataFrame:
    """profile <-> post, each pair once."""
    return _pairs_both_ways(read_table(spark, path, LIKES), "post_id", "post", "like")


def duplicate_likes(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``duplicates``: the rows of a likes file that ``likes`` leaves out."""
    rows = read_table(spark, path, LIKES)
    return rows.groupBy("profile_id", "post_id").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of posts; counts that aren't numbers are 0."""
    rows = read_table(spark, path, POSTS)
    return rows.withColumns({c: lenient_int(F.col(c)) for c in ("likes_count", "reposts_count")})


def professor_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, RATINGS).withColumn("nota", lenient_int(F.col("nota")))


def professor_posts(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, PROFESSOR_POSTS).withColumn("likes_count", lenient_int(F.col("likes_count")))


def professors(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of professors, best grade first."""
    rows = read_table(spark, path, PROFESSORS)
    return rows.withColumns({c: lenient_int(F.col(c)) for c in ("nota", "qts_avaliacao")}).orderBy(F.col("nota").desc(), "id")


def professor_graph(spark: SparkSession, ratings_path: str, posts_path: str) -> DataFrame:
    """profile <-> professor: rated (``avaliou``) and posted about (``postou``), each pair once per source."""
    rated = _pairs_both_ways(read_table(spark, ratings_path, RATINGS), "professor_id", "professor", "avaliou")
    return rated.unionByName(_pairs_both_ways(read_table(spark, posts_path, PROFESSOR_POSTS), "professor_id", "professor", "postou"))


def professor_interactions(spark: SparkSession, path: str) -> DataFrame:
    """profile <-> professor of the older export, each pair once."""
    return _pairs_both_ways(read_table(spark, path, PROFESSOR_LIKES), "professor_id", "professor", "liked_professor")


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """profile -> item edges of ``users.tsv``, ``items.tsv`` and ``interactions.tsv``.

    An interaction whose user or item isn't in its file is an error, raised when the rows are computed; so are an id
    that is no whole number, a weight that doesn't begin with a number and a line with columns missing or left over.
    """
    whole = lambda df, *names: df.withColumns({n: strict_int(F.col(n)) for n in names})
    u = whole(read_tsv(spark, f"{folder}/users.tsv", USERS), *USERS)
    i = whole(read_tsv(spark, f"{folder}/items.tsv", ITEMS), "item_idx", "db_id").select("item_idx", F.concat_ws(":", "tipo", F.col("db_id").cast("string")).alias("item"))
    rows = whole(read_tsv(spark, f"{folder}/interactions.tsv", INTERACTIONS), "user_idx", "item_idx").join(u, "user_idx", "left").join(i, "item_idx", "left")
    known = F.when(F.col("profile_id").isNull() | F.col("item").isNull(), F.raise_error(F.concat(F.lit("unknown user or item: "), F.concat_ws("/", F.col("user_idx").cast("string"), F.col("item_idx").cast("string")))).cast("string"))
    number = F.regexp_extract("weight", r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?", 0)
    weight = F.when(number == "", F.raise_error(F.lit("a weight is no number")).cast("double")).otherwise(number.try_cast("double"))
    return edge_log(rows, F.coalesce(known, vertex_id("profile", F.col("profile_id"))), F.col("item"), F.lit("interaction"), weight)


def adjacency_lists(spark: SparkSession, path: str) -> DataFrame:
    """user -> item edges of lines ``user item item ...``; lines without items give none."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts[0].alias("user"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("item"))
    return edge_log(rows, vertex_id("user", F.col("user")), vertex_id("item", F.col("item")), F.lit("interacted"), F.lit(1.0))
