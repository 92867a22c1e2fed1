"""References to records that do not exist.

A ledger holds signed counts per key and time: how many rows refer to the key and how often it exists. Change deltas
raise and lower both and arrive in batches, which are kept summed as Parquet. A key with positive references and no
existence is an orphan; since records are created, deleted and come late, the running counts tell at which times that
holds, and the orphan rows are those whose key and time lie in such a stretch of the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.runtime import materialize, scratch

#: References are counted per key and slot of this length, which bounds the ledger's rows of a key by its time span.
SLOT_US = 30 * 86_400_000_000
#: Times are no earlier than this (some 290,000 years ago), and whole slots can be told from all of them.
MIN_US, MAX_US = -(2**63) + 2 * SLOT_US, 2**63 - 1
#: The slot of references whose time is unknown.
UNDATED = -(2**63)
#: References of a slot that share a salt, about; a slot is salted if it also has 1 / MOST_HOT of all references.
SALT_ROWS, MOST_HOT = 1_000_000, 10_000


@dataclass(frozen=True)
class References:
    """Rows of ``df`` that refer: their ``row_id``, the table referred to (``space``), the ``key`` and the time ``at``."""

    field: str
    df: DataFrame
    row_id: Column
    space: Column
    key: Column
    at: Column


def references(field: str, df: DataFrame, row_id: Column, space: Column, key: Column, at: Column) -> References:
    """The non-null references of ``df``; other columns are ignored. A null ``space`` names no table: never found."""
    return References(field, df, row_id, F.coalesce(space, F.lit("?")), key.cast("long"), F.unix_micros(at))


def records(space: str, df: DataFrame, key: Column, created: Column, deleted: Column) -> DataFrame:
    """The records of a table as (``space``, ``key``, ``born_us``, ``died_us``), whole repetitions taken once."""
    return df.select(
        F.lit(space).alias("space"), key.cast("long").alias("key"), F.unix_micros(created).alias("born_us"),
        F.unix_micros(deleted).alias("died_us"),
    ).where(F.col("key").isNotNull()).distinct()


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with the same columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reference_rows(refs: Sequence[References]) -> DataFrame:
    """All references as (``ref_field``, ``row_id``, ``space``, ``key``, ``at_us``), a table that holds several read once."""
    tables: dict[int, list[References]] = {}
    for r in refs:
        tables.setdefault(id(r.df), []).append(r)
    parts = [
        own[0].df.select(F.inline(F.array(*[
            F.struct(F.lit(r.field).alias("ref_field"), r.row_id.cast("long").alias("row_id"), r.space.alias("space"), r.key.alias("key"), r.at.alias("at_us")) for r in own
        ])))
        for own in tables.values()
    ]
    return united(parts).where(F.col("key").isNotNull())


def _slot(at: Column) -> Column:
    """The start of the slot of a time."""
    return at - F.pmod(at, F.lit(SLOT_US))


def _dated(at: Column) -> Column:
    return F.when(at.isNotNull(), F.greatest(at, F.lit(MIN_US)))


def reference_deltas(refs: Sequence[References], sign: int = 1) -> DataFrame:
    """Signed reference changes (``space``, ``key``, ``at_us``, ``d_refs``); rows that are withdrawn have ``sign`` -1."""
    return reference_rows(refs).select("space", "key", "at_us", F.lit(sign).alias("d_refs"))


def existence_deltas(targets: DataFrame, sign: int = 1) -> DataFrame:
    """Signed existence changes (``space``, ``key``, ``at_us``, ``d_exists``) of records.

    +1 when born (long ago, if unknown), -1 when deleted. A record deleted no later than it was born never existed
    at any time; it leaves one change of 0, by which its key is still known.
    """
    born = F.coalesce("born_us", F.lit(MIN_US))
    never = F.col("died_us") <= born
    up = F.struct(born.alias("at_us"), (F.when(never, 0).otherwise(1) * sign).alias("d_exists"))
    down = F.struct(F.col("died_us").alias("at_us"), F.lit(-sign).alias("d_exists"))
    changes = F.when(never | F.col("died_us").isNull(), F.array(up)).otherwise(F.array(up, down))
    return targets.select("space", "key", F.inline(changes))


_COUNTS = ("d_refs", "d_exists", "changes")


def ledger_rows(ref_deltas: DataFrame | None, exist_deltas: DataFrame | None) -> DataFrame:
    """Deltas summed per (``space``, ``key``, ``slot``, ``at_us``): ``d_refs``, ``d_exists`` and the number of ``changes`` of existence.

    References stand at the start of their slot (those of unknown time in the slot UNDATED), so they combine before the
    shuffle and a key has no more rows of them than its time span has slots, however many refer to it; existence
    changes stand at their own instant.
    """
    parts = []
    none = F.lit(0).cast("long")
    if ref_deltas is not None:
        slot = F.when(F.col("at_us").isNull(), F.lit(UNDATED)).otherwise(_slot(_dated(F.col("at_us"))))
        parts.append(ref_deltas.select("space", "key", slot.alias("slot"), slot.alias("at_us"), F.col("d_refs").cast("long").alias("d_refs"), none.alias("d_exists"), none.alias("changes")))
    if exist_deltas is not None:
        at = _dated(F.col("at_us"))
        parts.append(exist_deltas.select("space", "key", _slot(at).alias("slot"), at.alias("at_us"), none.alias("d_refs"), F.col("d_exists").cast("long").alias("d_exists"), F.lit(1).cast("long").alias("changes")))
    return united(parts).groupBy("space", "key", "slot", "at_us").agg(*[F.sum(c).alias(c) for c in _COUNTS])


class Ledger:
    """The counts of all batches so far, kept in a folder all executors share.

    Each batch is a folder of summed deltas named after its number. A batch applied again after a failure overwrites its
    own folder, so the state is the same however often that happens. One process may write at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def apply(self, batch: int, ref_deltas: DataFrame | None = None, exist_deltas: DataFrame | None = None) -> Ledger:
        """Take in the deltas of ``batch``; it costs their own size, whatever is stored already."""
        if ref_deltas is not None or exist_deltas is not None:
            ledger_rows(ref_deltas, exist_deltas).write.mode("overwrite").parquet(f"{self.path}/batch={int(batch)}")
        return self

    def rows(self) -> DataFrame:
        """The ledger: the rows of all batches, summed; those that sum to nothing are left out."""
        stored = self.spark.read.schema("space string, key long, slot long, at_us long, d_refs long, d_exists long, changes long").parquet(self.path)
        summed = stored.groupBy("space", "key", "slot", "at_us").agg(*[F.sum(c).alias(c) for c in _COUNTS])
        return summed.where((F.col("d_refs") != 0) | (F.col("changes") != 0) | (F.col("d_exists") != 0))

    def current_orphans(self) -> DataFrame:
        """Keys that are referred to and don't exist after all changes: (``space``, ``key``, ``refs``)."""
        now = self.rows().groupBy("space", "key").agg(F.sum("d_refs").alias("refs"), F.sum("d_exists").alias("exists"))
        return now.where((F.col("refs") > 0) & (F.col("exists") <= 0)).select("space", "key", "refs")


def orphan_stretches(ledger: DataFrame) -> DataFrame:
    """Where the ledger has positive references and no existence: (``space``, ``key``, ``slot``, ``from_us``, ``to_us``, ``refs``).

    A stretch holds from one row of the ledger (included) to the next (excluded) and within its slot, whose references
    are ``refs``. References of unknown time are orphans only if their key is unknown altogether; theirs is (0, 1). The
    windows see rows of the ledger, never rows that refer.
    """
    key = Window.partitionBy("space", "key")
    order = key.orderBy("slot", "at_us")
    undated = F.col("slot") == UNDATED
    running = ledger.select(
        "space", "key", "slot", "at_us", F.lead("at_us", 1, MAX_US).over(order).alias("next_us"),
        F.sum("d_exists").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("exists"),
        F.sum("changes").over(key).alias("known"), F.sum("d_refs").over(Window.partitionBy("space", "key", "slot")).alias("refs"),
    )
    void = F.when(undated, F.col("known") <= 0).otherwise(F.col("exists") <= 0)
    return running.where((F.col("refs") > 0) & void).select(
        "space", "key", "slot", F.when(undated, 0).otherwise(F.col("at_us")).alias("from_us"), F.when(undated, 1).otherwise(F.col("next_us")).alias("to_us"), "refs"
    )


def rows_in(rows: DataFrame, stretches: DataFrame, ledger: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The ``rows`` (of ``reference_rows``) that lie in ``stretches`` of the ledger.

    Slots with very many references, of which there are at most MOST_HOT, are told to the rows by broadcast; these rows
    are spread over as many salts as the ledger's count of them asks for.
    """
    total = ledger.agg(F.sum("d_refs")).first()[0] or 0
    least = max(salt_rows, total // MOST_HOT)
    salts = F.ceil(F.col("refs") / F.lit(salt_rows)).cast("int")
    hot = ledger.where(F.col("d_refs") >= least).select("space", "key", "slot", F.ceil(F.col("d_refs") / F.lit(salt_rows)).cast("int").alias("salts"))
    slot = F.when(F.col("at_us").isNull(), F.lit(UNDATED)).otherwise(_slot(_dated(F.col("at_us"))))
    placed = rows.withColumn("slot", slot).join(F.broadcast(hot), ["space", "key", "slot"], "left")
    salted = placed.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int")))
    copies = stretches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("refs") >= least, salts - 1).otherwise(0))))
    # of the two sides, that of the stretches is always the far smaller one: it has a row per key, slot and change at most
    met = salted.join(copies.drop("refs").hint("shuffle_hash"), ["space", "key", "slot", "salt"])
    at = F.coalesce(_dated(F.col("at_us")), F.lit(0))
    # stretches of a key don't overlap, so a row meets one at most
    return met.where((at >= F.col("from_us")) & (at < F.col("to_us"))).select("ref_field", "row_id", "space", "key", "at_us")


def orphan_rows(refs: Sequence[References], targets: Sequence[DataFrame], salt_rows: int = SALT_ROWS, ledger: Ledger | None = None) -> DataFrame:
    """The references whose key has no existence at their time: ``ref_field``, ``row_id``, ``space``, ``key``, ``at_us``.

    They are found through ``ledger``, which must hold the deltas of ``refs`` and ``targets``; without one, a ledger
    of one batch is made of them. A reference of unknown time is an orphan only if its key is unknown altogether. A row
    of ``refs`` yields at most one result row; repeated rows come out as often as they occur. Empty tables: no
    references, no orphans; no targets, all orphans. Each table that refers is read twice: for its deltas, and for the
    rows that lie in orphan stretches.
    """
    if ledger is None:
        spark = targets[0].sparkSession
        ledger = Ledger(spark, scratch(spark, "ledger")).apply(0, reference_deltas(refs), existence_deltas(united(targets)))
    kept = ledger.rows()
    return rows_in(reference_rows(refs), materialize(orphan_stretches(kept), "orphan-stretches"), kept, salt_rows)


def orphan_report(orphans: DataFrame, targets: Sequence[DataFrame]) -> DataFrame:
    """Orphan references per field, month of the row's time and reason: ``ref_field``, ``period``, ``reason``, ``n``.

    ``period`` is the UTC month as YYYY-MM, ``unknown`` for a row without a time. ``reason`` is ``missing`` (no such
    record at any time), ``early`` (before its record was created) or ``gone`` (its record was deleted).
    """
    per = orphans.groupBy("ref_field", "space", "key", "at_us").agg(F.count(F.lit(1)).alias("n"))
    born = united(targets).groupBy("space", "key").agg(F.min(F.coalesce("born_us", F.lit(MIN_US))).alias("born_us"))
    reason = F.when(F.col("born_us").isNull(), "missing").when(F.col("at_us") < F.col("born_us"), "early").otherwise("gone")
    month = F.coalesce(
        F.date_format(F.to_date(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at_us") / 86_400_000_000).cast("int"))), "yyyy-MM"),
        F.lit("unknown"),
    )
    return per.join(born, ["space", "key"], "left").groupBy("ref_field", month.alias("period"), reason.alias("reason")).agg(F.sum("n").alias("n"))
