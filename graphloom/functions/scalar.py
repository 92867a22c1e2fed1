"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vertex_id(kind: str, value: Column) -> Column:
    """The id ``kind:value`` of a vertex; null if the value is."""
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def vertex_kind(vid: Column) -> Column:
    """What stands before the first colon of an id."""
    return F.substring_index(vid, ":", 1)


def lenient_int(text: Column) -> Column:
    """The whole number a text begins with, 0 if there is none, it is null or doesn't fit 64 bits."""
    return F.coalesce(F.regexp_extract(text, "^[+-]?[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def strict_int(text: Column) -> Column:
    """The whole number a text is; any other text is an error, raised when the row is computed. Null stays null."""
    number = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text).try_cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("no whole number: "), text)).cast("bigint")
    return F.when(text.isNull() | number.isNotNull(), number).otherwise(wrong)


def padded(text: Column, width: int) -> Column:
    """``text`` with blanks after it up to ``width`` characters; a longer one stays as it is."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def bar(n: Column, sign: str = "#") -> Column:
    """``sign`` repeated ``n`` times."""
    return F.repeat(F.lit(sign), n.cast("int"))


def suffix_int(vid: Column, kind: str) -> Column:
    """N of an id ``kind:N``, null for any other text."""
    return F.when(vid.rlike(rf"\A{kind}:[+-]?[0-9]+\z"), F.substring_index(vid, ":", -1)).try_cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b isn't positive."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def dot(a: str, b: str) -> Column:
    """The dot product of two arrays of doubles of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def draw(*key: Column | str | int) -> Column:
    """A reproducible number from 0 to 2^32 - 1 that depends on nothing but its key."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
