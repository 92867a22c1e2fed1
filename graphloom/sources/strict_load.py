r"""Strict loading of tab-separated interaction lines, with the failures told apart.

Only lines that conform as a whole are loaded; all other records are what remains of the raw lines when the loaded
offsets are taken away, and only those are diagnosed. A line can thus neither be lost nor be both loaded and rejected.

A record has four tab-separated fields: ``user_idx``, ``item_idx`` (32-bit integers), ``weight`` (a finite double) and
``inserted_at`` (an existing date and time, UTC unless it carries an offset). A field may stand in double quotes as a
whole. White space (space, tab, CR) at the end of a line is dropped first; null lines and lines then empty are no
records, neither are header lines (``line_no`` 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize

FIELDS = ("user_idx", "item_idx", "weight", "inserted_at")

INT = r"-?[0-9]+"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
TIME = (
    r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
    r"(?:\.[0-9]{1,6})?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?"
)
#: A field in quotes (doubled quotes and tabs may stand inside) or one without any quote.
FIELD = r'(?:"(?:[^"]|"")*+"|[^\t"]*+)'


def records(raw: DataFrame) -> DataFrame:
    """The records among the raw lines, with their offsets: ``line_id``, ``batch``, ``line_no``, ``line``."""
    told = raw.where(~F.col("line_no").eqNullSafe(1)).select("line_id", "batch", "line_no", "raw_line")
    trimmed = F.rtrim("raw_line", F.lit(" \t\r"))
    return _once(told, line=trimmed).where(F.length("line") > 0).select("line_id", "batch", "line_no", "line")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once per row: later filters and columns read them instead of repeating them."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))


def _value(k: int) -> Column:
    """Field ``k`` of a conforming line without its quotes."""
    return F.replace(F.element_at("parts", k), F.lit('"'), F.lit(""))


def _int32(text: Column) -> Column:
    """Digits, however many, as a 32-bit integer; null if out of range."""
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(text, "^-?0*(?=[0-9])", "")
    wide = F.when(F.length(digits) <= 10, digits).try_cast("long") * sign
    return F.when(wide.between(-(2**31), 2**31 - 1), wide.cast("int"))


def _time(text: Column) -> Column:
    """The instant of a text that has the form of ``TIME``; null if there is no such date. The year 0000 doesn't exist."""
    day = F.when(text.substr(1, 4) != "0000", text.substr(1, 10)).try_cast("date")
    clock = text.substr(12, 2).try_cast("long") * 3600 + text.substr(15, 2).try_cast("long") * 60 + text.substr(18, 2).try_cast("long")
    fraction = F.rpad(F.regexp_extract(text, r"\.([0-9]{1,6})", 1), 6, "0").try_cast("long")
    zone = F.regexp_extract(text, r"[ T].*([+-][0-9]{2}:[0-9]{2})$", 1)
    ahead = F.when(zone == "", 0).otherwise(
        F.when(zone.startswith("-"), -60).otherwise(60) * (zone.substr(2, 2).try_cast("long") * 60 + zone.substr(5, 2).try_cast("long"))
    )
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return F.timestamp_micros((days * 86_400 + clock - ahead) * 1_000_000 + fraction)


def strict_load(raw: DataFrame) -> DataFrame:
    """The valid lines as typed rows.

    ``line_id``, ``batch``, ``line_no``, ``user_idx INT``, ``item_idx INT``, ``weight DOUBLE``, ``inserted_at TIMESTAMP``.
    ``raw`` has ``line_id`` (unique), ``batch``, ``line_no`` and ``raw_line``; other columns are ignored.
    """
    quoted = lambda p: f'(?:"{p}"|{p})'
    whole = r"\A" + r"\t".join(quoted(p) for p in (INT, INT, NUMBER, TIME)) + r"\z"
    # a line that conforms holds tabs between its fields and quotes around them only
    parts = _once(records(raw).where(F.col("line").rlike(whole)).select("line_id", "batch", "line_no", "line"), parts=F.split("line", "\t"))
    bare = _once(parts, user=_value(1), item=_value(2), number=_value(3), time=_value(4))
    typed = _once(
        bare, user_idx=_int32(F.col("user")), item_idx=_int32(F.col("item")), weight=F.col("number").try_cast("double"), inserted_at=_time(F.col("time"))
    )
    finite = F.abs("weight") < F.lit(float("inf"))
    return typed.where(
        F.col("user_idx").isNotNull() & F.col("item_idx").isNotNull() & finite & F.col("inserted_at").isNotNull()
    ).select("line_id", "batch", "line_no", "user_idx", "item_idx", "weight", "inserted_at")


def rejected_offsets(raw: DataFrame) -> DataFrame:
    """The offsets (``line_id``) of the records that weren't loaded: all records' less those of ``strict_load``.

    Only offsets are shuffled.
    """
    return records(raw).select("line_id").join(strict_load(raw).select("line_id"), "line_id", "left_anti")


def rejects(raw: DataFrame) -> DataFrame:
    """The records that weren't loaded, with the first reason found.

    ``line_id``, ``batch``, ``line_no``, ``raw_line``, ``reason``: ``quoting`` (a quote inside a field, or one left
    open), ``columns`` (not four fields), ``user_idx``, ``item_idx``, ``weight`` or ``inserted_at`` (that value has
    the wrong form, is out of range or names no existing time). They are the records at ``rejected_offsets``; their
    lines are fetched for these alone.
    """
    # written once: a small remainder then meets the lines by broadcast, and only a large one makes them move
    rejected = materialize(rejected_offsets(raw), "rejected-offsets")
    left = records(raw).join(rejected, "line_id", "left_semi")
    well_quoted = F.col("line").rlike(rf"\A{FIELD}(?:\t{FIELD})*+\z")
    fields = F.when(well_quoted, F.regexp_extract_all("line", F.lit(rf"(?:\A|(?<=\t))({FIELD})(?=\t|\z)"), 1))
    bare = F.transform(fields, lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    split = _once(left, fields=bare)
    at = lambda k: F.element_at("fields", k)
    is_form = lambda k, p: at(k).rlike(rf"\A{p}\z")
    reason = (
        F.when(F.col("fields").isNull(), "quoting")
        .when(F.size("fields") != len(FIELDS), "columns")
        .when(~is_form(1, INT) | _int32(at(1)).isNull(), "user_idx")
        .when(~is_form(2, INT) | _int32(at(2)).isNull(), "item_idx")
        .when(~is_form(3, NUMBER) | ~F.coalesce(F.abs(at(3).try_cast("double")) < F.lit(float("inf")), F.lit(False)), "weight")
        .otherwise("inserted_at")
    )
    return split.select("line_id", "batch", "line_no", F.col("line").alias("raw_line"), reason.alias("reason"))
