"""Money and percentages: decimal(19,2), rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,2)"


def money(x: Column) -> Column:
    return x.cast(MONEY)


def total(x: Column) -> Column:
    """A sum as money, 0 for no rows."""
    return F.coalesce(F.sum(x), F.lit(0)).cast(MONEY)


def total_if(condition: Column, x: Column) -> Column:
    return total(F.when(condition, x))


def percent(part: Column, whole: Column, scale: int = 2) -> Column:
    """part * 100 / whole, rounded once; 0 where whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0).otherwise(F.round(part * 100 / whole, scale)).cast(f"decimal(19,{scale})")


def whole_percent(part: Column, whole: Column) -> Column:
    """part / whole rounded at two decimals and then times 100: whole per cents. Null where whole is 0."""
    return (F.round(part / F.nullif(whole, F.lit(0)), 2) * 100).cast("decimal(19,2)")


def ratio_percent(part: Column, whole: Column) -> Column:
    """part / whole rounded at six decimals, times 100, rounded at two; 0 where whole is 0."""
    ratio = F.round(part / F.nullif(whole, F.lit(0)), 6)
    return F.coalesce(F.round(ratio * 100, 2), F.lit(0)).cast("decimal(19,2)")


def parse_brazilian(x: Column) -> Column:
    """1.234,56 with currency sign, leading or trailing or Unicode minus; null if it is no number."""
    plain = F.regexp_replace(F.regexp_replace(x, "[−–]", "-"), r"[^0-9,\-]", "")
    minus = plain.contains("-")
    value = F.regexp_replace(F.regexp_replace(plain, "-", ""), ",", ".").try_cast(MONEY)
    return F.when(minus, -value).otherwise(value).cast(MONEY)


def parse_loose(x: Column) -> Column:
    """As parse_brazilian, but d.dd without a comma keeps its point."""
    plain = F.trim(F.regexp_replace(x, r"[^0-9,.\-]", ""))
    return F.when(plain.rlike(r"^-?\d+\.\d{1,2}$"), plain.try_cast(MONEY)).otherwise(parse_brazilian(x))


def amount_after(text: Column, label: str) -> Column:
    """The first amount after a label, on the same or a later line."""
    found = F.regexp_extract(text, rf"(?is)(?:{label}).*?(-?\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}|-?\d+,\d{{2}})", 1)
    return parse_brazilian(F.nullif(found, F.lit("")))


def brazilian(x: Column) -> Column:
    """R$ 1.234,56 for message columns."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", ".,"))
