"""Column expressions shared by the operators: coercion, money, calendars, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that stand for NULL (fixed values, matched exactly after trimming).
NULL_TEXTS = ("", "nan", "NA", "N/A", "NULL", "null", "None")


def clean_text(c: Column) -> Column:
    """Trimmed text, NULL for the texts that stand for it."""
    t = F.trim(c)
    return F.when(t.isin(*NULL_TEXTS), None).otherwise(t)


def to_long(c: Column) -> Column:
    """Whole numbers, also when written as ``17850.0``; anything else is NULL."""
    t = clean_text(c)
    d = t.try_cast("double")
    return F.coalesce(t.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint")))


def to_double(c: Column) -> Column:
    return clean_text(c).try_cast("double")


def money(c: Column) -> Column:
    """Two decimal places, exact."""
    return c.cast("decimal(12,2)")


def cents(c: Column) -> Column:
    """An amount with two decimal places as a whole number of hundredths."""
    return F.rint(c * 100).cast("long")


def amount(c: Column) -> Column:
    """Hundredths as double."""
    return c / F.lit(100.0)


def sum0(c: Column) -> Column:
    """A sum that is 0, not NULL, where there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_timestamp(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text to a timestamp in the session's time zone; text that is none, or of another form, is NULL."""
    return F.try_to_timestamp(clean_text(c), F.lit(pattern))


def short_number(c: Column) -> Column:
    """An exact number as text with one decimal: 1.2M, 12.3k, 7.0 (halves away from zero)."""
    d = c.cast("decimal(24,2)")
    one = lambda n: F.round(d / F.lit(n).cast("decimal(8,0)"), 1).cast("decimal(20,1)").cast("string")
    return F.when(F.abs(d) >= 1_000_000, F.concat(one(1_000_000), F.lit("M"))).when(F.abs(d) >= 1000, F.concat(one(1000), F.lit("k"))).otherwise(one(1))


def escape_xml(c: Column) -> Column:
    """Text for an XML document: the five reserved characters as entities."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def blend(low: str, high: str, t: Column) -> Column:
    """A colour #rrggbb between two, ``t`` held in 0 to 1; channels are rounded half up."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    parts = []
    for i in (1, 3, 5):
        a, b = int(low[i : i + 2], 16), int(high[i : i + 2], 16)
        parts.append(F.lpad(F.lower(F.hex(F.floor(F.lit(float(a)) + t * float(b - a) + 0.5).cast("long"))), 2, "0"))
    return F.concat(F.lit("#"), *parts)


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def date_key(c: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.date_format(c, "yyyyMMdd").cast("int")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def sunday_zero(c: Column) -> Column:
    """Day of the week, Sunday 0."""
    return F.dayofweek(c) - 1


def is_weekend(c: Column) -> Column:
    return F.dayofweek(c).isin(1, 7)


def clip_upper(c: Column, top: Column) -> Column:
    """The value or the bound, NULL staying NULL."""
    return F.when(c > top, top).otherwise(c)


def same_text(a: Column, b: Column) -> Column:
    """Equality without regard to case."""
    return F.lower(a) == F.lower(b)
