"""Filters, sums and monthly series over transactions and statement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import month, month_index, period_end, period_start
from tallyspark.functions.money import MONEY, percent, total, total_if
from tallyspark.functions.text import DEFAULT_CATEGORY, category_or_default
from tallyspark.operators.classifying import ordered_rule


def default_range(start: str | None, end: str | None, as_of: str) -> tuple[Column, Column]:
    """A missing end takes the other end; without either it is the month of as_of."""
    if not start and not end:
        d = F.lit(as_of).cast("date")
        return F.trunc(d, "month"), F.last_day(d)
    return F.lit(start or end).cast("date"), F.lit(end or start).cast("date")


def live(tx: DataFrame) -> DataFrame:
    return tx.where("deleted_at is null")


def filter_transactions(tx: DataFrame, start: str | None = None, end: str | None = None, as_of: str = "", types: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Live rows within both ends, of some types, of a category in any case."""
    low, high = default_range(start, end, as_of)
    out = live(tx).where(F.col("transaction_date").between(low, high))
    if types:
        out = out.where(F.col("type").isin(types))
    return out.where(F.lower("category") == category.lower()) if category else out


def sum_by_type(tx: DataFrame) -> DataFrame:
    return tx.groupBy("person_id").agg(total_if(F.col("type") == "INCOME", F.col("amount")).alias("income"), total_if(F.col("type") == "EXPENSE", F.col("amount")).alias("expense"))


def category_totals(tx: DataFrame) -> DataFrame:
    return tx.where("type = 'EXPENSE'").groupBy("person_id", category_or_default(F.col("category")).alias("category")).agg(total(F.col("amount")).alias("total"))


def month_type_totals(tx: DataFrame) -> DataFrame:
    return tx.groupBy("person_id", month(F.col("transaction_date")).alias("month"), "type").agg(total(F.col("amount")).alias("total"), F.count("*").alias("n"))


def base_cube(tx: DataFrame) -> DataFrame:
    """The one large aggregate that monthly consumers share: a row per person, month, type, card flag and category."""
    return live(tx).groupBy("person_id", month(F.col("transaction_date")).alias("month"), "type", F.col("purchase_date").isNotNull().alias("card"), category_or_default(F.col("category")).alias("category")).agg(
        F.sum("amount").cast(MONEY).alias("total"), F.sum(F.abs("amount")).cast(MONEY).alias("total_abs"), F.count("*").alias("n")
    )


def monthly_summary(cube: DataFrame) -> DataFrame:
    """Income, expenses, balance and the savings rate in whole per cent, by person and month."""
    sums = cube.groupBy("person_id", "month").agg(total_if(F.col("type") == "INCOME", F.col("total")).alias("income"), total_if(F.col("type") == "EXPENSE", F.col("total")).alias("expenses"))
    balance = (F.col("income") - F.col("expenses")).cast(MONEY)
    return sums.select("*", balance.alias("balance"), percent(balance, F.col("income"), 0).cast("bigint").alias("savings_rate"))


def dashboard_totals(cube: DataFrame, year: int, month_no: int) -> DataFrame:
    """Totals of a month and of its year up to that month, in one pass."""
    inside = cube.where((F.year("month") == year) & (F.month("month") <= month_no))
    now = F.month("month") == month_no
    of = lambda kind, extra: total_if((F.col("type") == kind) & extra, F.col("total"))
    out = inside.groupBy("person_id").agg(of("INCOME", now).alias("month_income"), of("EXPENSE", now).alias("month_expenses"), of("INCOME", F.lit(True)).alias("year_income"), of("EXPENSE", F.lit(True)).alias("year_expenses"))
    return out.withColumn("month_balance", (F.col("month_income") - F.col("month_expenses")).cast(MONEY)).withColumn("year_balance", (F.col("year_income") - F.col("year_expenses")).cast(MONEY))


def charts_cube(tx: DataFrame, stx: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """base_cube of transactions and statement rows, told apart by source. Of statements, credits are income and debits expenses that
    no card made, of absolute amounts; balances and payments of card bills are left out. Their category is that of the first of the rules that fits."""
    rows = kept_statement_rows(stx).where(F.col("type").isin("CREDIT", "DEBIT"))
    rows = ordered_rule(rows, rules, DEFAULT_CATEGORY) if rules is not None else rows.withColumn("rule_category", F.lit(DEFAULT_CATEGORY))
    kind = F.when(F.col("type") == "CREDIT", "INCOME").otherwise("EXPENSE")
    size = F.abs("amount")
    kept = rows.groupBy(F.col("user_id").alias("person_id"), month(F.col("transaction_date")).alias("month"), kind.alias("type"), category_or_default(F.col("rule_category")).alias("category")).agg(F.sum(size).cast(MONEY).alias("total"), F.sum(size).cast(MONEY).alias("total_abs"), F.count("*").alias("n"))
    own = base_cube(tx).withColumn("source", F.lit("transaction"))
    return own.unionByName(kept.withColumn("card", F.lit(False)).withColumn("source", F.lit("statement")))


def category_breakdown(cube: DataFrame, period: str = "month") -> DataFrame:
    """Expenses by category and month, or year, with their share of it, ranked; none where all is 0. Of a cube with statements, their debits count too."""
    start = F.trunc("month", period).alias("month")
    sums = cube.where("type = 'EXPENSE'").groupBy("person_id", start, "category").agg(F.sum("total_abs").cast(MONEY).alias("total"))
    group = Window.partitionBy("person_id", "month")
    whole = F.sum("total").over(group)
    return sums.withColumn("whole", whole).where("whole <> 0").select("person_id", "month", "category", "total", percent(F.col("total"), F.col("whole")).alias("percent"), F.row_number().over(group.orderBy(F.desc("total"), "category")).cast("bigint").alias("rank"))


def month_grid(people: DataFrame, first: str, months: int) -> DataFrame:
    """Each person with each of so many months from the first."""
    start = F.lit(first).cast("date")
    return people.select("person_id").distinct().select("person_id", F.explode(F.sequence(start, F.add_months(start, months - 1), F.expr("interval 1 month"))).alias("month"))


def monthly_evolution(cube: DataFrame, first: str, months: int) -> DataFrame:
    """A row for every person and month; months without rows are 0. Income is that of transactions, as booked, and statements' credits, which are
    income_checking; expenses are those of cards and of checking accounts: statements' debits and what no card made. cube: charts_cube, or
    base_cube, which has no statements."""
    last = F.add_months(F.lit(first).cast("date"), months - 1)
    statement = F.col("source") == "statement" if "source" in cube.columns else F.lit(False)
    expense = F.col("type") == "EXPENSE"
    sums = cube.where(F.col("month").between(F.lit(first).cast("date"), last)).groupBy("person_id", "month").agg(
        total_if(F.col("type") == "INCOME", F.col("total")).alias("income"),
        total_if(expense, F.col("total_abs")).alias("expenses"),
        total_if((F.col("type") == "INCOME") & statement, F.col("total")).alias("income_checking"),
        total_if(expense & ~F.col("card"), F.col("total_abs")).alias("expenses_checking"),
        total_if(expense & F.col("card"), F.col("total_abs")).alias("expenses_card"),
    )
    return month_grid(cube, first, months).join(sums, ["person_id", "month"], "left").na.fill(0)


def latest(tx: DataFrame, n: int = 200, most: int = 500) -> DataFrame:
    """The newest n transactions of each person, n at most `most`."""
    order = Window.partitionBy("person_id").orderBy(F.desc("transaction_date"), "tx_id")
    return live(tx).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(n, most))


def page(tx: DataFrame, number: int, size: int) -> DataFrame:
    """A page of each person's transactions, newest first, with the number of pages. Counts by day tell which days lie on
    the page, and only their rows are ranked, each day on its own; days come by date, rows of a day by id, rows without a date last."""
    low, high = number * size, number * size + size
    rows = live(tx)
    group = Window.partitionBy("person_id")
    newest = group.orderBy(F.desc_nulls_last("transaction_date")).rowsBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy("person_id", "transaction_date").agg(F.count("*").alias("c")).select("person_id", "transaction_date", (F.sum("c").over(newest) - F.col("c")).alias("before"), F.col("c"), F.sum("c").over(group).alias("n"))
    days = days.where((F.col("before") < high) & (F.col("before") + F.col("c") > low)).select(F.col("person_id").alias("on_person"), F.col("transaction_date").alias("on_day"), "before", "n")
    on = F.col("person_id").eqNullSafe(F.col("on_person")) & F.col("transaction_date").eqNullSafe(F.col("on_day"))
    place = F.row_number().over(Window.partitionBy("person_id", "transaction_date").orderBy("tx_id"))
    ranked = rows.join(days, on).withColumn("rank", (F.col("before") + place).cast("int")).drop("on_person", "on_day", "before")
    return ranked.where(F.col("rank").between(low + 1, high)).withColumn("pages", F.expr(f"(n + {size - 1}) div {size}"))


def is_bill_payment(description: Column, kind: Column) -> Column:
    """A debit that pays a card's bill."""
    d = F.lower(description)
    return (kind == "DEBIT") & (d.contains("fatura") | d.contains("invoice")) & (d.contains("cart") | d.contains("card") | d.contains("pag") | d.contains("pay"))


def kept_statement_rows(stx: DataFrame) -> DataFrame:
    """Without balances, untyped rows and payments of card bills, which would count twice."""
    return stx.where((F.col("type") != "BALANCE") & ~F.coalesce(is_bill_payment(F.col("description"), F.col("type")), F.lit(False)))


def cashflow(tx: DataFrame, stx: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Live transactions and mapped statement rows, which keep their signed amount. A statement row's category is that of the
    first of the rules (as in classifying.ordered_rule, by the statement's types) that fits, else the default one."""
    rows = kept_statement_rows(stx).where("transaction_date is not null and trim(description) <> ''")
    rows = ordered_rule(rows, rules, DEFAULT_CATEGORY) if rules is not None else rows.withColumn("rule_category", F.lit(DEFAULT_CATEGORY))
    mapped = rows.select(
        F.concat(F.lit("s"), F.col("stx_id").cast("string")).alias("tx_id"), F.col("user_id").alias("person_id"), "description", "amount",
        F.when(F.col("type") == "CREDIT", "INCOME").otherwise("EXPENSE").alias("type"), F.col("rule_category").alias("category"), "transaction_date", F.col("transaction_date").alias("purchase_date"), F.lit("PAID").alias("status"), F.lit("statement").alias("origin"),
    )
    own = live(tx).withColumn("origin", F.lit("transaction"))
    return own.select("tx_id", "person_id", "description", "amount", "type", "category", "transaction_date", "purchase_date", "status", "origin").unionByName(mapped)


def statement_summary(stx: DataFrame, statements: DataFrame) -> DataFrame:
    """By user and month: credits, all else as expenses, balance, count (one more for the opening
    line), opening of the first and closing of the last statement."""
    key = month(F.col("transaction_date")).alias("month")
    rows = stx.where("type <> 'BALANCE'").groupBy("user_id", key).agg(
        total_if(F.col("type") == "CREDIT", F.abs("amount")).alias("credits"), total_if(F.col("type") != "CREDIT", F.abs("amount")).alias("expenses"), F.count("*").alias("rows")
    )
    ends = statement_ends(statements)
    return rows.join(ends, ["user_id", "month"], "left").select(
        "user_id", "month", "credits", "expenses", (F.col("credits") - F.col("expenses")).cast(MONEY).alias("balance"), (F.col("rows") + F.when(F.col("opening").isNotNull(), 1).otherwise(0)).alias("n"), "opening", "closing"
    )


def statement_ends(statements: DataFrame) -> DataFrame:
    return statements.groupBy("user_id", month(F.col("statement_date")).alias("month")).agg(F.min_by("opening_balance", "statement_date").alias("opening"), F.max_by("closing_balance", "statement_date").alias("closing"))


def period_summary(tx: DataFrame, kind: str) -> DataFrame:
    """Absolute sums by report period, with those of the period before and the differences."""
    return cube_period_summary(base_cube(tx), kind)


def cube_period_summary(cube: DataFrame, kind: str) -> DataFrame:
    """period_summary of a cube."""
    now = cube.groupBy("person_id", period_start(F.col("month"), kind).alias("period_start")).agg(total_if(F.col("type") == "INCOME", F.col("total_abs")).alias("income"), total_if(F.col("type") == "EXPENSE", F.col("total_abs")).alias("expenses"))
    months = {"MONTHLY": 1, "SEMIANNUAL": 6, "ANNUAL": 12}[kind]
    # the period before is so many months away; rows without a date have none
    near = Window.partitionBy("person_id").orderBy("idx").rangeBetween(-months, -months)
    past = lambda name: F.coalesce(F.when(F.col("idx").isNotNull(), F.sum(name).over(near)), F.lit(0)).alias(f"p_{name}")
    joined = now.withColumn("idx", month_index(F.col("period_start"))).select("*", past("income"), past("expenses"))
    return joined.select("person_id", "period_start", period_end(F.col("period_start"), kind).alias("period_end"), "income", "expenses", F.col("p_income").cast(MONEY).alias("previous_income"), F.col("p_expenses").cast(MONEY).alias("previous_expenses"), (F.col("income") - F.col("p_income")).cast(MONEY).alias("income_change"), (F.col("expenses") - F.col("p_expenses")).cast(MONEY).alias("expense_change"))


def period_breakdown(tx: DataFrame, kind: str) -> DataFrame:
    """Sums by period, type and category with their share of the type."""
    return cube_period_breakdown(base_cube(tx), kind)


def cube_period_breakdown(cube: DataFrame, kind: str) -> DataFrame:
    """period_breakdown of a cube."""
    sums = cube.groupBy("person_id", period_start(F.col("month"), kind).alias("period_start"), "type", "category").agg(F.sum("total_abs").cast(MONEY).alias("total"))
    whole = F.sum("total").over(Window.partitionBy("person_id", "period_start", "type"))
    return sums.select("*", percent(F.col("total"), whole).alias("percent"))
