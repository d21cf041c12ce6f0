"""Health scores, insights, goals, reports and upload ingest, each for all persons at once."""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_index, period_start
from tallyspark.functions.money import MONEY, total_if, whole_percent
from tallyspark.functions.shared import clustered, saved
from tallyspark.functions.sizes import grows
from tallyspark.functions.text import description_key
from tallyspark.operators import classifying, detection, ingesting, invoicing, portfolio, summaries
from tallyspark.sources import texts


def _steps(x: Column, steps: list[tuple[float, int]], default: int, below: bool = True) -> Column:
    """The value of the first step that x lies at or under (below), else at or over."""
    out = None
    for limit, value in steps:
        hit = x <= limit if below else x >= limit
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def utilization_score(cards: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices of the owner's newest month against all card limits."""
    limits = cards.groupBy("owner_id").agg(F.sum("limit_amount").alias("limit"))
    owned = invoices.where("deleted_at is null").join(cards.select("card_id", "owner_id"), "card_id").withColumn("idx", F.col("year") * 12 + F.col("month"))
    month = owned.groupBy("owner_id", "idx").agg(F.sum("total_amount").alias("billed"))
    last = month.groupBy("owner_id").agg(F.max_by("billed", "idx").alias("billed"))
    used = F.round(F.col("billed") * 100 / F.nullif(F.col("limit"), F.lit(0)), 2)
    score = _steps(used, [(30, 100), (50, 90), (70, 70), (90, 50)], 20)
    return limits.join(last, "owner_id", "left").select(F.col("owner_id").alias("person_id"), F.when((F.col("limit") <= 0) | F.col("billed").isNull(), 100).otherwise(score).alias("utilization"))


def on_time_score(cards: DataFrame, invoices: DataFrame, as_of: str) -> DataFrame:
    """Of past invoices that aren't open, those paid by their due date."""
    owned = invoices.where("deleted_at is null").join(cards.select("card_id", "owner_id"), "card_id")
    past = owned.where((F.col("due_date") < F.lit(as_of).cast("date")) & (F.col("status") != "OPEN"))
    ok = (F.col("status") == "PAID") & (F.col("paid_date") <= F.col("due_date"))
    share = F.count_if(ok) * 100.0 / F.count("*")
    return past.groupBy(F.col("owner_id").alias("person_id")).agg(_steps(share, [(100, 100), (90, 90), (80, 70), (70, 50)], 20, below=False).alias("on_time"))


def diversity_score(tx: DataFrame, as_of: str, days: int = 90, categories: int = 10) -> DataFrame:
    end = F.lit(as_of).cast("date")
    rows = summaries.live(tx).where(F.col("transaction_date").between(F.date_sub(end, days), end) & (F.col("type") == "EXPENSE") & (F.col("status") != "CANCELLED"))
    used = F.count_distinct(F.nullif(F.lower(F.trim("category")), F.lit("")))
    return rows.groupBy("person_id").agg(used.alias("categories")).select("person_id", "categories", _steps(F.col("categories") * 100.0 / categories, [(80, 100), (60, 80), (40, 60), (20, 40)], 20, below=False).alias("diversity"))


def consistency_score(tx: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """Population variation of the monthly expenses of the last months, empty ones as 0; 100 without any."""
    last = month_index(F.lit(as_of).cast("date"))
    rows = summaries.live(tx).where((F.col("type") == "EXPENSE") & (F.col("status") != "CANCELLED")).withColumn("idx", month_index(F.col("transaction_date"))).where((F.col("idx") > last - months) & (F.col("idx") <= last))
    sums = rows.groupBy("person_id", "idx").agg(F.sum(F.abs("amount")).cast("double").alias("t")).groupBy("person_id").agg((F.sum("t") / months).alias("mean"), F.sum(F.col("t") * F.col("t")).alias("s2"))
    sd = F.sqrt(F.greatest(F.col("s2") / months - F.col("mean") * F.col("mean"), F.lit(0.0)))
    ratio = F.round(sd / F.col("mean") * 100, 6)
    score = F.when(F.col("mean") == 0, 100).when(ratio < 10, 100).when(ratio < 20, 80).when(ratio < 30, 60).when(ratio < 40, 40).otherwise(20)
    return sums.select("person_id", score.alias("consistency"))


def history_score(cards: DataFrame, invoices: DataFrame, as_of: str) -> DataFrame:
    owned = invoices.where("deleted_at is null").join(cards.select("card_id", "owner_id"), "card_id")
    years = F.datediff(F.lit(as_of).cast("date"), F.min("due_date")) / 365.25
    return owned.groupBy(F.col("owner_id").alias("person_id")).agg(F.when(years > 5, 100).when(years >= 3, 90).when(years >= 1, 70).when(years >= 0.5, 50).otherwise(20).alias("history"))


def health_scores(persons: DataFrame, tx: DataFrame, cards: DataFrame, invoices: DataFrame, as_of: str) -> DataFrame:
    """Five parts and their weighted sum, half up, 0 to 100; parts without data have their defaults."""
    parts = [utilization_score(cards, invoices), on_time_score(cards, invoices, as_of), diversity_score(tx, as_of).drop("categories"), consistency_score(tx, as_of), history_score(cards, invoices, as_of)]
    out = reduce(lambda a, b: a.join(b, "person_id", "left"), parts, persons.select("person_id").distinct())
    out = out.na.fill({"utilization": 100, "on_time": 100, "diversity": 20, "consistency": 100, "history": 20})
    weighted = F.col("utilization") * 25 + F.col("on_time") * 25 + F.col("diversity") * 20 + F.col("consistency") * 15 + F.col("history") * 15
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.floor((weighted + 50) / 100))).cast("int"))


INSIGHT = ["person_id", "ord", "rank", "type", "category", "message"]


def _insight(df: DataFrame, ord_: int, kind: Column | str, category: Column | str, message: Column, rank: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("person_id", F.lit(ord_).alias("ord"), (rank if rank is not None else F.lit(1)).cast("bigint").alias("rank"), lit(kind).alias("type"), lit(category).alias("category"), message.alias("message"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def flow_sums(cube: DataFrame, flow: DataFrame) -> DataFrame:
    """(person_id, month, income, expenses) of a cashflow: of its transactions from their cube, of its statement rows from themselves."""
    size, kind = F.abs("amount"), F.col("type")
    kept = flow.where("origin = 'statement'").groupBy("person_id", F.trunc("transaction_date", "month").alias("month"), "type").agg(F.sum(size).alias("total_abs"))
    both = cube.select("person_id", "month", "type", "total_abs").unionByName(kept)
    return both.groupBy("person_id", "month").agg(total_if(kind == "INCOME", F.col("total_abs")).alias("income"), total_if(kind == "EXPENSE", F.col("total_abs")).alias("expenses"))


def cashflow_insight(flow: DataFrame, month: str, cube: DataFrame | None = None) -> DataFrame:
    """Balance of the month's cashflow; a warning where it is negative. With a cube, transactions are taken from that, as in flow_sums."""
    m = F.lit(month).cast("date")
    if cube is None:
        rows = flow.where(F.trunc("transaction_date", "month") == m)
        sums = rows.groupBy("person_id").agg(total_if(F.col("type") == "INCOME", F.abs("amount")).alias("income"), total_if(F.col("type") == "EXPENSE", F.abs("amount")).alias("expenses"))
    else:
        sums = flow_sums(cube, flow).where(F.col("month") == m)
    sums = sums.where("income > 0 or expenses > 0")
    balance = (F.col("income") - F.col("expenses")).cast(MONEY)
    return _insight(sums, 5, F.when(balance < 0, "warning").otherwise("info"), "Cashflow", _text("balance ", balance))


def credit_limit_usage(cards: DataFrame, invoices: DataFrame, month: str) -> DataFrame:
    """Cards whose invoices of a month use more than 80 per cent of their limit, in whole per cent."""
    m = F.lit(month).cast("date")
    now = invoices.where((F.col("year") == F.year(m)) & (F.col("month") == F.month(m)) & F.col("deleted_at").isNull()).groupBy("card_id").agg(F.sum("total_amount").cast(MONEY).alias("billed"))
    used = now.join(cards.where("limit_amount > 0"), "card_id").withColumn("used", whole_percent(F.col("billed"), F.col("limit_amount")))
    return used.where("used > 80").select(F.col("owner_id").alias("person_id"), "card_id", "billed", "limit_amount", "used")


def first_insights(found: DataFrame, keep: int = 5) -> DataFrame:
    """Without repeats of category and message (trimmed, any case), the first by provider and rank; five a person."""
    key = Window.partitionBy("person_id", F.lower(F.trim("category")), F.lower(F.trim("message"))).orderBy("ord", "rank")
    one = found.withColumn("k", F.row_number().over(key)).where("k = 1").drop("k")
    place = F.row_number().over(Window.partitionBy("person_id").orderBy("ord", "rank", "category", "message"))
    return one.withColumn("place", place.cast("bigint")).where(F.col("place") <= keep)


#: Months before its own that an insight compares its month with.
COMPARED = 3
#: Insight providers by name: each a function of the inputs and the month. These read `recent`, the cube's months up to theirs.
PROVIDERS = {
    "cashflow": lambda x, m: cashflow_insight(x["flow"], m, x["recent"]),
    "top category": lambda x, m: _insight(detection.top_category(x["recent"]).where(F.col("month") == m), 10, "info", F.col("category"), _text("share ", F.col("percent"))),
    "uncategorised": lambda x, m: _insight(detection.default_quality(x["recent"]).where(F.col("month") == m), 11, "warning", "Outros", _text("share ", F.col("percent"))),
    "growth": lambda x, m: _insight(detection.monthly_growth(x["recent"]).where((F.col("month") == m) & (F.col("growth") > 10)), 20, "warning", "Growth", _text("growth ", F.col("growth"))),
    "anomaly": lambda x, m: _insight(detection.anomalies(x["recent"]).where(F.col("month") == m), 30, F.col("severity"), F.col("category"), _text("unusual ", F.col("total")), F.col("rank")),
    "recurring": lambda x, m: _insight(detection.listed(detection.recurring(x["flow"], x["as_of"]), "label", "monthly_cost"), 40, "info", "Assinaturas", _text(F.col("n"), " recurring: ", F.col("items"), ", ", F.col("total"))),
    "credit limit": lambda x, m: _insight(credit_limit_usage(x["cards"], x["invoices"], m), 50, "warning", "Credit", _text("used ", F.col("used")), F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("used"), "card_id"))),
    "budget": lambda x, m: _insight(detection.budget_exceeded(x["recent"], x["goals"], m).withColumn("r", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("excess"), "goal_id"))).where("r = 1"), 60, "alert", F.col("category"), _text("over by ", F.col("excess"))),
}


def _run_providers(inputs: dict, month: str, providers: dict | None) -> tuple[DataFrame, dict[str, Exception]]:
    """(insights, the failures by provider): each provider's rows are computed and written on their own."""
    found, failed = [], {}
    m = F.lit(month).cast("date")
    recent = inputs["cube"].where(F.col("month").between(F.add_months(m, -COMPARED), m))
    shared = inputs | {"recent": saved(recent, "insights-cube")}  # most providers read it
    with ThreadPoolExecutor(4) as pool:  # their jobs share the cluster, as those of one plan would
        runs = {name: pool.submit(lambda f=f: saved(f(shared, month).select(*INSIGHT), "insights")) for name, f in (providers or PROVIDERS).items()}
    for name, run in runs.items():
        try:
            found.append(run.result())
        except Exception as e:  # whatever a provider does, the others go on
            failed[name] = e
    none = inputs["cube"].sparkSession.createDataFrame([], "person_id bigint, ord int, rank bigint, type string, category string, message string")
    return reduce(lambda a, b: a.unionByName(b), found, none), failed


def run_providers(inputs: dict, month: str, providers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(insights, failures): each provider's rows are computed and written on their own; one that fails is left out and named in
    failures (provider, error, message), and the others' rows stay as they are. The insights are whole only where failures is empty: whoever
    doesn't read failures calls insights. inputs: cube, flow (cashflow), cards, invoices, goals, as_of.
    Providers are also given recent: the cube of the month and the COMPARED ones before it, written once, for which no other rows are joined or
    aggregated. cube is as it was given."""
    found, failed = _run_providers(inputs, month, providers)
    rows = [(name, type(e).__name__, str(e)[:500]) for name, e in failed.items()]
    return found, inputs["cube"].sparkSession.createDataFrame(rows, "provider string, error string, message string")


def insights(inputs: dict, month: str, providers: dict | None = None) -> DataFrame:
    """The first insights of all providers, with inputs as in run_providers. Where one of them fails, after the others have run, this fails too:
    without its rows others would come first, and the result would look whole."""
    found, failed = _run_providers(inputs, month, providers)
    if failed:
        raise RuntimeError("insight providers failed: " + "; ".join(f"{name} ({type(e).__name__}: {str(e)[:500]})" for name, e in failed.items())) from next(iter(failed.values()))
    return first_insights(found)


def _recent(flow: DataFrame, as_of: str, months: int = 3) -> DataFrame:
    """From the first day of the month so many months back up to as_of, with the divisor of months."""
    start = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -months)
    return flow.where(F.col("transaction_date").between(start, F.lit(as_of).cast("date")))


def _averages(recent: DataFrame) -> DataFrame:
    sums = recent.groupBy("person_id").agg(total_if(F.col("type") == "INCOME", F.abs("amount")).alias("i"), total_if(F.col("type") == "EXPENSE", F.abs("amount")).alias("e"), F.count_distinct(F.trunc("transaction_date", "month")).alias("n"))
    n = F.greatest(F.lit(3), F.least(F.lit(6), F.col("n")))
    return sums.select("person_id", n.alias("months"), F.round(F.col("i") / n, 2).cast(MONEY).alias("income"), F.round(F.col("e") / n, 2).cast(MONEY).alias("expenses"))


GOAL = ["person_id", "priority", "title", "target", "monthly", "months"]


def _goal(df: DataFrame, priority: int, title: Column, target: Column, monthly: Column, months: Column) -> DataFrame:
    return df.select("person_id", F.lit(priority).alias("priority"), title.alias("title"), target.cast(MONEY).alias("target"), monthly.cast(MONEY).alias("monthly"), months.cast("int").alias("months"))


def emergency_fund(recent: DataFrame) -> DataFrame:
    """Six months of expenses, or three where income is under 1.2 expenses; none where expenses are under 500."""
    a = _averages(recent).where("expenses >= 500")
    target = F.round(F.col("expenses") * F.when(F.col("income") >= F.col("expenses") * F.lit(1.2).cast("decimal(3,2)"), 6).otherwise(3), 2)
    monthly = F.greatest(F.when(F.col("income") > 0, F.round(F.col("income") * F.lit(0.1).cast("decimal(3,2)"), 2)).otherwise(F.round(F.col("expenses") * F.lit(0.05).cast("decimal(3,2)"), 2)), F.lit(50)).cast(MONEY)
    months = F.greatest(F.lit(6), F.least(F.lit(24), F.ceil(F.round(target / monthly, 6))))
    return _goal(a, 1, F.lit("Emergency fund"), target, monthly, months)


def debt_payoff(recent: DataFrame, debt: DataFrame) -> DataFrame:
    """For 500 or more outstanding: a sixth a month, no more than half the surplus, 150 at least; 3 to 24 months."""
    a = debt.where("outstanding >= 500").select(F.col("owner_id").alias("person_id"), "outstanding").join(_averages(recent), "person_id", "left").na.fill(0, ["income", "expenses"])
    surplus = F.col("income") - F.col("expenses")
    base = F.round(F.col("outstanding") / 6, 2)
    monthly = F.greatest(F.when(surplus > 0, F.least(base, surplus * F.lit(0.5).cast("decimal(3,2)"))).otherwise(base), F.lit(150))
    months = F.greatest(F.lit(3), F.least(F.lit(24), F.ceil(F.round(F.col("outstanding") / monthly, 6))))
    return _goal(a, 2, F.lit("Pay off debt"), F.col("outstanding"), F.round(monthly, 2), months)


def reducible_spending(recent: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """A tenth less of the largest category that isn't essential, from 150 a month and 30 saved; ties by name."""
    divisor = _averages(recent).select("person_id", "months")
    sums = recent.where("type = 'EXPENSE'").groupBy("person_id", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("Outros")).alias("category")).agg(F.sum(F.abs("amount")).cast(MONEY).alias("spent"))
    sums = detection.reducible(sums, words).where("reducible and spent > 0").drop("reducible")
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("spent"), "category"))).where("r = 1")
    a = top.join(divisor, "person_id").withColumn("average", F.round(F.col("spent") / F.col("months"), 2).cast(MONEY)).withColumn("goal", F.round(F.col("average") * F.lit(0.9).cast("decimal(3,2)"), 2).cast(MONEY))
    a = a.where("average >= 150 and average - goal >= 30")
    return _goal(a, 3, _text("Reduce ", F.col("category")), F.col("goal"), F.col("average") - F.col("goal"), F.lit(3))


def subscription_cleanup(flow: DataFrame, as_of: str, least_keys: int = 3, least_total: int = 30, words: DataFrame | None = None) -> DataFrame:
    """Likely subscriptions present in all three months, when there are some; target: their monthly cost."""
    last = month_index(F.lit(as_of).cast("date"))
    rows = detection.subscription_candidates(flow, words, 8, positive=True).withColumn("idx", month_index(F.col("transaction_date"))).where((F.col("idx") > last - 3) & (F.col("idx") <= last))
    keyed = rows.withColumn("key", description_key(F.col("description"))).where("key <> ''").groupBy("person_id", "key").agg(F.count_distinct("idx").alias("m"), F.sum(F.abs("amount")).alias("s")).where("m = 3")
    costs = keyed.select("person_id", F.round(F.col("s") / 3, 2).cast(MONEY).alias("cost"))
    a = costs.groupBy("person_id").agg(F.count("*").alias("n"), F.sum("cost").cast(MONEY).alias("total")).where(f"n >= {least_keys} and total >= {least_total}")
    return _goal(a, 3, F.lit("Clean up subscriptions"), F.col("total"), F.col("total"), F.lit(1))


def budget_optimization(cube: DataFrame) -> DataFrame:
    return _goal(detection.volatility(cube), 4, _text("Budget: ", F.col("category")), F.col("budget"), F.col("budget"), F.lit(3))


def fill_goals(suggested: DataFrame, goals: DataFrame, most: int = 4) -> DataFrame:
    """Suggestions up to four active goals: without titles that are active already or suggested twice."""
    active = goals.where("status = 'ACTIVE'").select(F.col("owner_id").alias("person_id"), F.lower(F.trim("title")).alias("t"))
    fresh = suggested.withColumn("t", F.lower(F.trim("title"))).join(active.distinct(), ["person_id", "t"], "left_anti")
    fresh = fresh.withColumn("k", F.row_number().over(Window.partitionBy("person_id", "t").orderBy("priority", "target"))).where("k = 1")
    room = active.groupBy("person_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("person_id").orderBy("priority", F.col("t").startswith("clean"), "target", "t"))
    placed = fresh.withColumn("place", place).join(room, "person_id", "left").where(f"place <= {most} - coalesce(n, 0)")
    return placed.select(*GOAL, F.col("place").cast("bigint").alias("place"))


def generate_goals(flow: DataFrame, cube: DataFrame, debt: DataFrame, goals: DataFrame, as_of: str) -> DataFrame:
    recent = _recent(flow, as_of)
    found = [emergency_fund(recent), debt_payoff(recent, debt), reducible_spending(recent), subscription_cleanup(flow, as_of), budget_optimization(cube)]
    return fill_goals(reduce(lambda a, b: a.unionByName(b), found), goals)


def monthly_insights(cube: DataFrame, flow: DataFrame, cards: DataFrame, invoices: DataFrame, goals: DataFrame, every: int = 1, keep: int = 5) -> DataFrame:
    """(person_id, month, insights): those of all providers as of each month that is the last of `every`, the first `keep` without repeats.
    cube is base_cube of flow's transactions, whose sums are taken from it; of a cube that is clustered by person nothing is shuffled."""
    c = F.col
    last = F.pmod(F.month("month"), F.lit(every)) == 0
    months = lambda df: df.where(last)
    # with so many months before those
    upto = lambda df, n: df.where(F.pmod(-F.month("month"), F.lit(every)) <= n)
    made = lambda df, ord_, kind, category, message, rank=F.lit(1): df.select("person_id", "month", F.lit(ord_).alias("ord"), rank.cast("bigint").alias("rank"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (F.lit(category) if isinstance(category, str) else category).alias("category"), message.alias("message"))
    sums = months(flow_sums(cube, flow)).where("income > 0 or expenses > 0")
    balance = (c("income") - c("expenses")).cast(MONEY)
    # the largest items and their sum by person and month, as listed does by person
    paid = detection.recurring_by_month(flow, every=every)
    place = F.row_number().over(Window.partitionBy("person_id", "month").orderBy(F.desc("monthly_cost"), "label"))
    items = paid.withColumn("r", place).groupBy("person_id", "month").agg(F.count("*").alias("n"), F.sum("monthly_cost").cast(MONEY).alias("total"), F.array_sort(F.collect_list(F.when(c("r") <= 4, F.struct("r", "label")))).alias("top"))
    names = F.concat(F.array_join(F.transform("top", lambda t: t["label"]), ", "), F.when(c("n") > 4, F.concat(F.lit(" and "), (c("n") - 4).cast("string"), F.lit(" more"))).otherwise(""))
    billed = invoices.where("deleted_at is null").groupBy("card_id", F.make_date("year", "month", F.lit(1)).alias("month")).agg(F.sum("total_amount").cast(MONEY).alias("billed"))
    used = months(billed).join(cards.where("limit_amount > 0"), "card_id").withColumn("used", whole_percent(c("billed"), c("limit_amount"))).where("used > 80").withColumn("person_id", c("owner_id"))
    wanted = goals.where("status = 'ACTIVE'").select("goal_id", c("owner_id").alias("person_id"), F.lower(F.trim(F.regexp_extract("title", r"(?i)^budget:\s*(.+)$", 1))).alias("key"), "target_amount").where("key <> ''")
    spent = months(cube).where("type = 'EXPENSE'").groupBy("person_id", "month", F.lower("category").alias("key")).agg(F.sum("total_abs").cast(MONEY).alias("spent"))
    over = wanted.join(spent, ["person_id", "key"]).where("spent > target_amount").withColumn("excess", (c("spent") - c("target_amount")).cast(MONEY))
    found = [
        made(sums, 5, F.when(balance < 0, "warning").otherwise("info"), "Cashflow", _text("balance ", balance)),
        made(months(detection.top_category(cube)), 10, "info", c("category"), _text("share ", c("percent"))),
        made(months(detection.default_quality(cube)), 11, "warning", "Outros", _text("share ", c("percent"))),
        made(months(detection.monthly_growth(upto(cube, 1))).where("growth > 10"), 20, "warning", "Growth", _text("growth ", c("growth"))),
        made(months(detection.anomalies(upto(cube, 3))), 30, c("severity"), c("category"), _text("unusual ", c("total")), c("rank")),
        made(items, 40, "info", "Assinaturas", _text(c("n"), " recurring: ", names, ", ", c("total"))),
        made(used, 50, "warning", "Credit", _text("used ", c("used")), F.row_number().over(Window.partitionBy("person_id", "month").orderBy(F.desc("used"), "card_id"))),
        made(over.withColumn("r", F.row_number().over(Window.partitionBy("person_id", "month").orderBy(F.desc("excess"), "goal_id"))).where("r = 1"), 60, "alert", c("key"), _text("over by ", c("excess"))),
    ]
    all_ = reduce(lambda a, b: a.unionByName(b), found).repartition("person_id")  # once for both windows and the groups
    same = Window.partitionBy("person_id", "month", F.lower(F.trim("category")), F.lower(F.trim("message"))).orderBy("ord", "rank")
    one = all_.withColumn("k", F.row_number().over(same)).where("k = 1")
    first = Window.partitionBy("person_id", "month").orderBy("ord", "rank", "category", "message")
    kept = one.withColumn("place", F.row_number().over(first)).where(c("place") <= keep)
    entry = F.struct("place", "ord", "rank", "type", "category", "message")
    return kept.groupBy("person_id", "month").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda i: i.dropFields("place")).alias("insights"))


def period_statements(stx: DataFrame, statements: DataFrame, kind: str, rows: int = 200) -> DataFrame:
    """(person_id, period_start, statements): sums without balances, the opening balance of the period's first statement and the closing
    one of its last, the number of rows of any type, and the first `rows` of them by date and id."""
    start = period_start(F.col("transaction_date"), kind).alias("period_start")
    own = stx.select(F.col("user_id").alias("person_id"), start, "stx_id", "transaction_date", "description", "amount", "type", *(["balance"] if "balance" in stx.columns else []))
    key = ["person_id", "period_start"]
    credits, expenses = total_if(F.col("type") == "CREDIT", F.abs("amount")), total_if(~F.col("type").isin("CREDIT", "BALANCE"), F.abs("amount"))
    sums = own.groupBy(*key).agg(credits.alias("credits"), expenses.alias("expenses"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("transaction_date", "stx_id"))
    entry = F.struct("place", *[c for c in own.columns if c not in key])
    first = own.withColumn("place", place).where(F.col("place") <= rows).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda r: r.dropFields("place")).alias("rows"))
    ends = statements.groupBy(F.col("user_id").alias("person_id"), period_start(F.col("statement_date"), kind).alias("period_start")).agg(F.min_by("opening_balance", "statement_date").alias("opening"), F.max_by("closing_balance", "statement_date").alias("closing"))
    joined = sums.join(first, key).join(ends, key, "left")
    return joined.select(*key, F.struct("opening", "closing", "credits", "expenses", (F.col("credits") - F.col("expenses")).cast(MONEY).alias("balance"), "n", "rows", F.lit(rows).alias("limited_to")).alias("statements"))


def period_reports(tx: DataFrame, kind: str, investments: DataFrame, budgets: DataFrame, assets: DataFrame, goals: DataFrame, stx: DataFrame, statements: DataFrame, cards: DataFrame, invoices: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """A JSON document per person and period: title, summary with the period before, breakdown, investments, assets, goals,
    budget, bank statements, and the insights of all providers as of the period's last month. Sections without data are left out. The
    facts are aggregated once, to a cube that is written by person. What a person has once is joined to the short summaries, and the long sections
    come last, each parted by person and period already, so that no document is shuffled."""
    cube = clustered(summaries.base_cube(tx), "reports-cube", "person_id")
    summary = summaries.cube_period_summary(cube, kind)
    parts = summaries.cube_period_breakdown(cube, kind).groupBy("person_id", "period_start").agg(F.array_sort(F.collect_list(F.struct("type", "category", "total", "percent"))).alias("breakdown"))
    whole = lambda df, name, *cols: df.select(F.col("owner_id").alias("person_id"), F.struct(*cols).alias(name))
    own = [
        whole(portfolio.investment_summary(investments).where("type is null"), "investments", "n", "initial", "current", "profitability"),
        whole(portfolio.asset_summary(assets).where("type is null"), "assets", "n", "current"),
        whole(portfolio.goal_summary(goals), "goals", "active", "completed", "canceled", "target", "current"),
        whole(portfolio.budget_health(budgets), "budget", "total", "balance", "healthy"),
    ]
    facts = F.struct("income", "expenses", "previous_income", "previous_expenses", "income_change", "expense_change").alias("summary")
    wide = reduce(lambda a, b: a.join(b, "person_id", "left"), own, summary.select("person_id", "period_start", "period_end", facts))
    every = {"MONTHLY": 1, "SEMIANNUAL": 6, "ANNUAL": 12}[kind]
    said = monthly_insights(cube, summaries.cashflow(tx, stx, rules), cards, invoices, goals, every)
    said = said.select("person_id", period_start(F.col("month"), kind).alias("period_start"), "insights")
    wide = reduce(lambda a, b: a.join(b, ["person_id", "period_start"], "left"), [period_statements(stx, statements, kind), said, parts], wide)
    title = _text(kind.capitalize(), " report ", F.date_format("period_start", "yyyy-MM-dd"), " to ", F.date_format("period_end", "yyyy-MM-dd")).alias("title")
    document = F.to_json(F.struct(title, "summary", "breakdown", "investments", "assets", "goals", "budget", "statements", "insights"))
    return wide.select("person_id", F.lit(kind).alias("report_type"), "period_start", "period_end", document.alias("data"))


def estimated_due(date: Column, due_day: Column) -> Column:
    """The card's due day, 1 to 28, else the tenth, of the month after a purchase."""
    day = F.when(due_day.between(1, 28), due_day).otherwise(10)
    return F.date_add(F.add_months(F.trunc(date, "month"), 1), (day - 1).cast("int"))


def invoice_totals(lines: DataFrame, stated: DataFrame, existing: DataFrame) -> DataFrame:
    """Invoices by card and month after uploads in the order of doc_id: each adds its lines (doc_id, card_key, year, month, amount, due_date) to what
    there is; one that states its total (doc_id, stated) and is of one invoice sets that invoice to it. So an invoice is what the last such
    upload states and what later ones add. action: insert, update or keep."""
    by = ["card_key", "year", "month"]
    added = saved(lines.groupBy("doc_id", *by).agg(F.sum("amount").alias("added"), F.max("due_date").alias("new_due")), "invoices-added")
    alone = added.groupBy("doc_id").agg(F.count("*").alias("n")).where("n = 1").join(stated.where("stated > 0"), "doc_id")
    sets = added.join(alone.select("doc_id", "stated"), "doc_id", "left")
    last = sets.where("stated is not null").groupBy(*by).agg(F.max(F.struct("doc_id", "stated")).alias("last"))
    sums = sets.join(last, by, "left").groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("last").isNull() | (F.col("doc_id") > F.col("last.doc_id")), F.col("added"))), F.lit(0)).alias("added"), F.max("last.stated").alias("stated"), F.max("new_due").alias("new_due")
    )
    old = existing.groupBy(*by).agg(F.sum("total_amount").alias("before"), F.min("due_date").alias("old_due"))
    c = F.col
    action = F.when(c("before").isNull(), "insert").when(c("added").isNull(), "keep").otherwise("update")
    whole = F.coalesce("stated", "before", F.lit(0)) + F.coalesce("added", F.lit(0))
    return sums.join(old, by, "full_outer").select(*by, whole.cast(MONEY).alias("total"), F.coalesce("old_due", "new_due").alias("due_date"), action.alias("action"))


def ingest(parsed: DataFrame, rules: DataFrame, feedback: DataFrame, past: DataFrame, dictionary: DataFrame, keywords: DataFrame, existing: DataFrame, cards: DataFrame, net: Column | None = None, amounts: DataFrame | None = None, one_invoice: list[str] | None = None, parts: Collection[str] | None = None) -> dict[str, DataFrame]:
    """One batch of uploads, in the order of doc_id: parsed rows to transactions, cards, installments, invoices and summaries.

    Rows without date or with amount 0 are left out; the transaction date is the due date, without one the card's due day in the month after the
    line's date, which is the purchase date. A category that a row brings stays, unless it is blank or the default; others are classified. A row's
    card is found or made as by invoicing.resolve_cards; without a brand in the names of card and file the card's name is its brand. A new card's key holds owner, brand, digits and name.
    Invoices are keyed by card and month; where a card's name in an upload holds one of the words of one_invoice, all rows of a month are of the invoice of the first one's card. Numbers and totals of instalments are the line's, 1 without.
    net: whether an upload's sum counts refunds as negative. amounts: the invoices' own figures, for the capture summary. parts: the results that are
    asked for, all if left out; what only others need isn't computed. Only parts gives entries, transactions without their categories. Rows, cards and what is read more than once are written.
    """
    c = F.col
    some = {"transactions", "cards", "new_cards", "installments", "invoices", "uploads", *(() if amounts is None else ("capture",))}
    some = some if parts is None else (some | {"entries"}) & set(parts)
    given = lambda name, type_: c(name) if name in parsed.columns else F.lit(None).cast(type_)
    own = F.nullif(F.trim(given("category", "string")), F.lit(""))
    good = parsed.where("date is not null and amount > 0").withColumn("own_category", F.when(~F.lower(own).isin("outros", "other"), own))
    out = {"capture": ingesting.capture_summary(good, amounts)} if "capture" in some else {}
    if not some - {"capture"}:
        return out
    file = F.coalesce(given("file_name", "string"), F.lit(""))
    seen = ingesting.card_identity(F.coalesce("card_name", F.lit("")), file)
    name = F.coalesce(F.nullif(F.trim("card_name"), F.lit("")), seen["brand"], F.nullif(file, F.lit("")), F.lit("Card"))
    rows = good.select(
        "doc_id", "line_no", "person_id", "description", "amount", "type", "date", given("due_date", "date").alias("due_date"), "card_name", "own_category", "document_total",
        F.coalesce(given("installment_number", "int"), F.lit(1)).alias("number"), F.coalesce(given("installment_total", "int"), F.lit(1)).alias("total"), name.alias("name"), F.coalesce(seen["brand"], name).alias("brand"), seen["last_four"].alias("last_four"),
    )
    # of a card's rows in an upload the first one tells whose they are; it goes with each, so that rows meet cards in one join
    rows = rows.select("*", *invoicing.card_keys(c("name"), c("brand"), c("last_four")))
    end = F.lit("|")  # no digits come after any
    place = F.struct("line_no", "brand", F.coalesce("last_four", end).alias("digits"), "name")
    rows = rows.withColumn("first", F.min(place).over(Window.partitionBy("person_id", "doc_id", "b", F.coalesce("d", "n")))).drop("b", "n", "d")
    rows = saved(rows, "ingest-rows")
    same = (c("brand") == c("first.brand")) & (F.coalesce("last_four", end) == c("first.digits")) & (c("name") == c("first.name"))
    keyed = rows.withColumn("owner_id", c("person_id")).select("*", *invoicing.card_keys(c("first.name"), c("first.brand"), F.nullif(c("first.digits"), end))).withColumn("at", F.struct(c("doc_id").alias("upload"), "first.*"))
    firsts = clustered(keyed.groupBy("owner_id", "b", "d", "n").agg(F.min("at").alias("at")), "ingest-cards", *invoicing.CARD_PARTS)
    known = cards if "due_day" in cards.columns else cards.withColumn("due_day", F.lit(None).cast("int"))
    hits, made = invoicing.card_hits(firsts, known, ("due_day",))
    said = lambda x, y: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.nullif(F.trim(y), F.lit("")))
    new_name = lambda at: (said(at["name"], at["brand"]), said(at["brand"], at["name"]), F.nullif(at["digits"], end))

    def new_key(at: Column) -> Column:
        name, brand, digits = new_name(at)
        return F.concat_ws("|", F.lit("new"), "owner_id", brand, F.coalesce(digits, F.lit("")), name)

    if "new_cards" in some:
        name, brand, digits = new_name(c("at"))
        out["new_cards"] = made.select("owner_id", name.alias("name"), brand.alias("brand"), digits.alias("last_four"), *invoicing.card_defaults(), new_key(c("at")).alias("card_key"))
    if some <= {"capture", "new_cards"}:
        return out
    met = firsts.drop("at").join(grows(hits["d"]), ["owner_id", "b", "d"], "left").join(grows(hits["n"]), ["owner_id", "b", "n"], "left").withColumn("d", F.coalesce("d", end))
    hit = invoicing.card_of(c("at"), hits["d"].schema["by_d"].dataType["card"].dataType.simpleString())
    found = keyed.withColumn("d", F.coalesce("d", end)).join(grows(met), ["owner_id", "b", "d", "n"]).withColumn("hit", hit)
    day = F.when(c("hit.card").isNull(), F.lit(invoicing.CARD_DEFAULTS["due_day"])).otherwise(c("hit.card.due_day"))
    found = found.select(
        *rows.columns, c("owner_id"), c("hit.card.card_id").alias("card_id"), F.when(same, c("hit.how")).otherwise("upload").alias("matched_by"),
        F.coalesce(c("hit.card.card_id").cast("string"), new_key(c("hit.since"))).alias("card_key"), day.alias("due_day"),
    )
    due = F.coalesce("due_date", estimated_due(c("date"), c("due_day")))
    # ids are put together where they are needed: they are longer than the rest of a row
    tx = found.select(
        _tx_id().alias("tx_id"), "doc_id", "line_no", "person_id", "description", "amount", "type", "own_category", due.alias("transaction_date"), c("date").alias("purchase_date"), "card_name", "card_key", "matched_by", "number", "total", "document_total"
    )
    if "entries" in some:
        out["entries"] = tx.drop("own_category", "number", "total", "document_total")
    if "transactions" in some:
        out["transactions"] = _categorised(tx.drop("tx_id", "number", "total", "document_total"), rows, rules, feedback, past, dictionary, keywords)
    if "cards" in some:
        out["cards"] = found.select("owner_id", "name", "brand", "last_four", "card_id", "matched_by", "card_key").distinct()
    if "installments" in some:
        out["installments"] = tx.select("doc_id", c("tx_id").alias("transaction_id"), "card_key", "number", "total", "amount", c("transaction_date").alias("due_date"))
    if not some & {"invoices", "uploads"}:
        return out
    month = [F.year("transaction_date").alias("year"), F.month("transaction_date").alias("month")]
    keyed = tx.select("doc_id", "line_no", "tx_id", "card_name", "card_key", *month, F.when(c("type") == "EXPENSE", c("amount")).otherwise(-c("amount")).alias("amount"), c("transaction_date").alias("due_date"))
    if one_invoice:
        keyed = saved(keyed, "ingest-keyed")
        bank = F.coalesce(*[F.when(F.lower("card_name").contains(w.lower()), w) for w in one_invoice])
        shared = keyed.groupBy("doc_id").agg(F.max(bank).alias("bank")).where("bank is not null")
        first = keyed.join(shared, "doc_id").groupBy("doc_id", "year", "month").agg(F.min_by("card_key", F.struct("line_no", "tx_id")).alias("first_card"))
        keyed = keyed.join(first, ["doc_id", "year", "month"], "left").withColumn("card_key", F.coalesce("first_card", "card_key")).drop("first_card")
    if "invoices" in some:
        stated = rows.groupBy("doc_id").agg(F.max("document_total").alias("stated"))
        out["invoices"] = invoice_totals(keyed, stated, existing.withColumn("card_key", c("card_id").cast("string")))
    if "uploads" in some:
        invoice = F.struct("card_key", "year", "month")
        alone = keyed.groupBy("doc_id").agg(F.min(invoice).alias("low"), F.max(invoice).alias("high")).where("low = high").select("doc_id", F.lit(True).alias("alone"))
        # totals that don't count are left out, so that all uploads may stand as of one invoice
        counted = rows.join(alone, "doc_id", "left").withColumn("document_total", F.when(c("alone"), c("document_total"))).withColumn("invoice_key", F.lit("one"))
        out["uploads"] = ingesting.upload_summary(counted, F.lit(True) if net is None else net)
    return out


def _tx_id() -> Column:
    return F.concat_ws("-", "doc_id", "line_no", "description", F.col("amount").cast("string"), "card_name")


def _categorised(tx: DataFrame, rows: DataFrame, rules: DataFrame, feedback: DataFrame, past: DataFrame, dictionary: DataFrame, keywords: DataFrame) -> DataFrame:
    """tx with category, confidence and category_by. A category found hangs on person and description alone, so each two are classified once."""
    c = F.col
    wanted = saved(rows.where("own_category is null").select("person_id", "description").distinct(), "ingest-texts")
    classes = classifying.categories(wanted, rules, feedback, past, dictionary, keywords)
    classes = classes.select(c("person_id").alias("__who"), c("description").alias("__text"), c("category").alias("found_category"), c("confidence").alias("found_confidence"), c("reason").alias("found_by"))
    out = tx.join(classes, c("person_id").eqNullSafe(c("__who")) & c("description").eqNullSafe(c("__text")) & c("own_category").isNull(), "left")
    own = c("own_category").isNotNull()
    category, by = F.coalesce("own_category", "found_category").alias("category"), F.when(own, "given").otherwise(c("found_by")).alias("category_by")
    return out.select(_tx_id().alias("tx_id"), "doc_id", "line_no", "person_id", "description", "amount", "type", category, c("found_confidence").alias("confidence"), by, "transaction_date", "purchase_date", "card_name", "card_key", "matched_by")


def ingest_texts(docs: DataFrame, jobs: DataFrame, layouts: DataFrame, patterns: DataFrame, *tables: DataFrame, least_score: int = 75, least_text: int = 800, duplicates: str = "keep", **options) -> dict[str, DataFrame]:
    """A batch of uploaded invoice texts (doc_id, person_id, sha256, password, due_date, card_name, text) through all stages: ingest of what is left.

    Uploads that a job (person_id, sha256, job_id, status, password, due_date, created_at) has done already are reused; texts are parsed by the layout
    that fits best; documents whose extraction scores under least_score are refused; lines that are no purchases (patterns: layout, pattern) go, duplicates
    too with duplicates = drop. A text's own total is what it states. tables and options are those of ingest; added results: reused
    (doc_id, reused_job) and refused (doc_id, score)."""
    docs = saved(docs, "upload-docs")  # the only time that uploads are derived
    files = docs.select("person_id", "sha256", F.col("doc_id").alias("file_id"), "password", "due_date")
    checked = saved(texts.dedup_uploads(files, jobs).select(F.col("file_id").alias("doc_id"), "reused_job"), "uploads")
    reused = {"reused": checked.where("reused_job is not null")}
    wanted = options.get("parts")
    if wanted is not None and set(wanted) <= {"reused"}:
        return reused
    # by document from here on: its lines, their layout, totals, scores and cards in the upload are found without another shuffle of texts or lines
    fresh = docs.join(grows(checked.where("reused_job is null").select("doc_id")), "doc_id", "left_semi")
    fresh = clustered(fresh, "upload-texts", "doc_id", parted=True)
    found = clustered(texts.parse_invoice_text(fresh.select("doc_id", "text"), layouts), "upload-rows", "doc_id", parted=True)
    chosen = texts.select_layout(fresh.select("doc_id", "text"), found, layouts).select("doc_id", F.array("layout").alias("chosen"))
    # an array, as Spark would make a compared column a key of the join, by which rows aren't parted
    rows = found.join(grows(chosen), "doc_id").where("array_contains(chosen, layout)").drop("chosen")
    rows = clustered(rows, "upload-chosen", "doc_id", parted=True)
    stated = saved(ingesting.expected_total(texts.lines_of(fresh)).withColumnRenamed("expected", "total_amount"), "upload-totals")
    seen = ingesting.card_identity(F.coalesce("card_name", F.lit("")), F.lit(""))
    facts = fresh.select("doc_id", "text", F.coalesce("due_date", texts.due_date(F.col("text"))).alias("due_date"), seen["last_four"].alias("last_four")).join(grows(stated), "doc_id", "left")
    quality = saved(ingesting.parse_quality(facts, rows, least_text=least_text).select("doc_id", "score"), "upload-scores")
    refused = {"refused": quality.where(F.col("score") < least_score)}
    if wanted is not None and set(wanted) <= {"reused", "refused"}:
        return reused | refused
    rows = rows.join(grows(quality.where(F.col("score") >= least_score).select("doc_id")), "doc_id", "left_semi")
    rows = ingesting.drop_non_purchases(rows, patterns)
    own = fresh.select("doc_id", "person_id", "card_name", F.col("due_date").alias("given_due")).join(grows(stated.withColumnRenamed("total_amount", "document_total")), "doc_id", "left")
    rows = rows.join(grows(own), "doc_id").withColumn("due_date", F.coalesce("given_due", "due_date")).drop("given_due")
    return ingest(ingesting.remove_duplicates(rows, duplicates), *tables, **options) | reused | refused
