"""Months, report periods, and dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviated months, Portuguese and English.
MONTHS = {"jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12}
PERIODS = {"MONTHLY": 1, "SEMIANNUAL": 6, "ANNUAL": 12}


def month(x: Column) -> Column:
    return F.trunc(x, "month")


def month_index(x: Column) -> Column:
    return F.year(x) * 12 + F.month(x) - 1


def month_of_index(i: Column) -> Column:
    """The first day of the month with an index."""
    return F.make_date(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1))


def period_start(x: Column, kind: str) -> Column:
    n = PERIODS[kind]
    return F.make_date(F.year(x), (F.floor((F.month(x) - 1) / n) * n + 1).cast("int"), F.lit(1))


def period_end(start: Column, kind: str) -> Column:
    return F.date_add(F.add_months(start, PERIODS[kind]), -1)


def month_number(name: Column) -> Column:
    key = F.lower(F.substring(name, 1, 3))
    pairs = [x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def day_and_month(t: Column) -> tuple[Column, Column]:
    """Day and month, two digits each, of dd MON and dd/MM; null for what has another shape."""
    day = F.lpad(F.nullif(F.regexp_extract(t, r"^(\d{1,2})(?: +[A-Za-z]{3,}\.?|/\d{1,2})$", 1), F.lit("")), 2, "0")
    worded = F.regexp_extract(t, r"^(\d{1,2}) +([A-Za-z]{3,})\.?$", 2)
    number = F.nullif(F.regexp_extract(t, r"^\d{1,2}/(\d{1,2})$", 1), F.lit(""))
    return day, F.when(worded != "", F.lpad(month_number(worded).cast("string"), 2, "0")).otherwise(F.lpad(number, 2, "0"))


def try_date(year: Column, month: Column, day: Column) -> Column:
    """Null where the parts make no date: 29 February only is one in a leap year."""
    first = F.when((year >= 1) & month.between(1, 12) & day.between(1, 31), F.make_date(year, month, F.lit(1)))
    return once(F.struct(F.date_add(first, day - 1).alias("date"), month.alias("month")), lambda d: F.when(F.month(d["date"]) == d["month"], d["date"]))


def once(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def parse_date(x: Column, as_of: Column) -> Column:
    """dd MON, ISO, dd/MM/yyyy, dd/MM/yy and dd/MM; a date without a year takes as_of's, or the one
    before where it would lie more than a month ahead. Null where it is no date of that year.

    The shape is told by the text with all digits alike, and its parts are cut out as numbers: formats that don't fit aren't tried."""
    number = lambda t, at, n: F.substring(t, at, n).cast("int")

    def yearless(d):
        # 29 February of a common year lies ahead where 1 March does: no limit lies between
        ahead = (F.year(d["limit"]) == d["year"]) & (d["month"] * 100 + d["day"] > F.month(d["limit"]) * 100 + F.dayofmonth(d["limit"]))
        return try_date(d["year"] - F.when(ahead, 1).otherwise(0), d["month"], d["day"])

    def read(p):
        t, shape = p["text"], p["shape"]
        day, month_of = day_and_month(t)
        parts = F.struct(F.year(as_of).alias("year"), F.add_months(as_of, 1).alias("limit"), month_of.try_cast("int").alias("month"), day.try_cast("int").alias("day"))
        iso = try_date(number(t, 1, 4), number(t, 6, 2), number(t, 9, 2))
        slashed = lambda year: try_date(year, number(t, 4, 2), number(t, 1, 2))
        return F.when(shape == "0000-00-00", iso).when(shape == "00/00/0000", slashed(number(t, 7, 4))).when(shape == "00/00/00", slashed(number(t, 7, 2) + 2000)).otherwise(once(parts, yearless))

    t = F.trim(x)
    return once(F.struct(t.alias("text"), F.translate(t, "123456789", "000000000").alias("shape")), read)


def estimated_due(purchase: Column, due_day: Column) -> Column:
    """The next month's due day, 10 where it isn't 1 to 28."""
    next_month = F.add_months(F.trunc(purchase, "month"), 1)
    return F.date_add(next_month, F.when(due_day.between(1, 28), due_day).otherwise(10) - 1)
