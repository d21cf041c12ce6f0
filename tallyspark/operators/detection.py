"""Windows over months and days: growth, anomalies, recurring payments, trips, volatility, critical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_index, month_of_index
from tallyspark.functions.money import MONEY, percent, total_if, whole_percent
from tallyspark.functions.shared import saved
from tallyspark.functions.text import DEFAULT_CATEGORY, category_or_default, description_key, loose, normalize
from tallyspark.operators.classifying import word_kinds

TRANSFER_HINTS = ["pix", "transfer", "ted", "doc", "saque", "withdrawal"]
SUBSCRIPTION_HINTS = ["plan", "assinatura", "subscription", "mensal", "premium"]
ESSENTIAL = ["moradia", "aluguel", "saude", "educacao", "housing", "health", "education", "rent"]


def top_category(cube: DataFrame) -> DataFrame:
    """Each person-month's largest category of expenses with its share at one decimal; ties by name."""
    group = Window.partitionBy("person_id", "month")
    sums = cube.where("type = 'EXPENSE'").groupBy("person_id", "month", "category").agg(F.sum("total_abs").cast(MONEY).alias("total"))
    ranked = sums.select("*", F.sum("total").over(group).alias("whole"), F.row_number().over(group.orderBy(F.desc("total"), "category")).alias("r")).where("r = 1 and whole > 0")
    return ranked.select("person_id", "month", "category", "total", percent(F.col("total"), F.col("whole"), 1).alias("percent"))


def monthly_expenses(cube: DataFrame) -> DataFrame:
    return cube.where("type = 'EXPENSE'").groupBy("person_id", "month").agg(F.sum("total_abs").cast(MONEY).alias("total"))


def monthly_growth(cube: DataFrame) -> DataFrame:
    """Growth of expenses against the calendar month before, in whole per cent; none without one."""
    near = Window.partitionBy("person_id").orderBy("idx").rangeBetween(-1, -1)
    now = monthly_expenses(cube).withColumn("idx", month_index(F.col("month"))).withColumn("previous", F.sum("total").over(near).cast(MONEY))
    return now.where("previous > 0").select("person_id", "month", "total", "previous", whole_percent(F.col("total") - F.col("previous"), F.col("previous")).alias("growth"))


def anomalies(cube: DataFrame, keep: int = 3) -> DataFrame:
    """Categories far above their three months before: at least two with spending; above mean and two
    standard deviations (1.75 means where that is 0), above 1.35 means, and by more than 50."""
    cells = cube.where("type = 'EXPENSE'").groupBy("person_id", "category", "month").agg(F.sum("total_abs").cast(MONEY).alias("total")).where("total > 0")
    before = Window.partitionBy("person_id", "category").orderBy("idx").rangeBetween(-3, -1)
    d = F.col("total").cast("double")
    stats = cells.withColumn("idx", month_index(F.col("month"))).select("*", F.avg(d).over(before).alias("mean"), F.coalesce(F.stddev_samp(d).over(before), F.lit(0.0)).alias("sd"), F.count("*").over(before).alias("n"))
    limit = F.when(F.col("sd") == 0, 1.75 * F.col("mean")).otherwise(F.col("mean") + 2 * F.col("sd"))
    hits = stats.where((F.col("n") >= 2) & (d > limit) & (d > 1.35 * F.col("mean")) & (d - F.col("mean") > 50))
    rank = F.row_number().over(Window.partitionBy("person_id", "month").orderBy(F.desc(F.round(d - F.col("mean"), 4)), "category"))
    return hits.select("person_id", "month", "category", "total", F.round("mean", 4).alias("mean"), F.when(d > 2 * F.col("mean"), "alert").otherwise("warning").alias("severity"), rank.cast("bigint").alias("rank")).where(F.col("rank") <= keep)


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def is_subscription_candidate(tx: DataFrame, least: float = 5, positive: bool = False, transfers: list[str] = TRANSFER_HINTS, hints: list[str] = SUBSCRIPTION_HINTS) -> Column:
    """An expense of some size with a description that holds no word of transfers; positive: also one of hints, in the description or its category's beginning.
    Words are parts of a text, in lower case and without accents."""
    text = normalize(F.coalesce("description", F.lit("")))
    ok = (F.col("type") == "EXPENSE") & (F.abs("amount") >= least) & (text != "") & ~_holds(text, transfers)
    hint = _holds(text, hints) | normalize(F.coalesce("category", F.lit(""))).startswith("assin")
    return ok & hint if positive else ok


def subscription_candidates(tx: DataFrame, words: DataFrame | None = None, least: float = 5, positive: bool = False) -> DataFrame:
    """The rows that may be subscriptions. words: a table (kind, pattern) of any size with the kinds transfer and subscription, in place of our own few words."""
    if words is None:
        return tx.where(is_subscription_candidate(tx, least, positive))
    known = word_kinds(tx.where(is_subscription_candidate(tx, least, transfers=[])), words)
    ok = ~F.array_contains("kinds", "transfer")
    wanted = F.array_contains("kinds", "subscription") | normalize(F.coalesce("category", F.lit(""))).startswith("assin")
    return known.where(ok & wanted if positive else ok).drop("kinds")


def recurring(tx: DataFrame, as_of: str, months: int = 3, words: DataFrame | None = None) -> DataFrame:
    """Recurring payments of the three months to as_of: (person, key, label, n, monthly_cost), as in recurring_by_month."""
    last = month_index(F.lit(as_of).cast("date"))
    return recurring_by_month(tx.where(month_index(F.col("transaction_date")).between(last - months + 1, last)), months, F.lit(as_of).cast("date"), words).drop("month")


def recurring_by_month(tx: DataFrame, months: int = 3, until: Column | None = None, words: DataFrame | None = None, every: int = 1) -> DataFrame:
    """(person, key, month, label, n, monthly_cost) of each month, or of that of `until`, or of each that is the last of `every`: recurring payments of the three months to as_of: (person, key, label, rows, monthly cost). Clusters of amounts, from the
    smallest up, each within 5 per cent or 2 of its first; at least three rows in all three months, of a small deviation (5 or
    8 per cent of the mean), whose first days of the months lie within 10 days. Label: the commonest description.

    Rows in no span that is asked for and blank keys are left out first. The rest is counted once by amount, month and description, so that a
    group of many rows is few, and counts are repeated for those spans only whose every month has rows of the key; these are written. Where
    clusters begin is a fold over a group's different amounts: each begins over 5 per cent and 2 above the one before, so there are few of
    them, and all else are aggregates.
    """
    rows = subscription_candidates(tx.where("transaction_date is not null"), words).withColumn("idx", month_index(F.col("transaction_date")))
    if until is None:
        rows = rows.where(F.pmod(-F.col("idx") - 1, F.lit(every)) < months)
    rows = rows.withColumn("key", description_key(F.col("description"))).where("key <> ''").withColumn("cents", (F.abs("amount") * 100).cast("bigint"))
    name = F.trim(F.coalesce("description", F.lit(""))).alias("name")
    counts = rows.groupBy(F.col("person_id").cast("bigint").alias("person_id"), "key", "cents", "idx", name).agg(F.count("*").alias("n"), F.min("transaction_date").alias("at"))
    # each row counts in the spans of so many months that end with its own month or one of the next
    ends = F.array(month_index(until)) if until is not None else F.filter(F.sequence(F.col("idx"), F.col("idx") + months - 1), lambda e: (e + 1) % every == 0)
    known = counts.withColumn("known", F.collect_set("idx").over(Window.partitionBy("person_id", "key")))
    whole = F.filter(ends, lambda e: F.forall(F.sequence(e - months + 1, e), lambda i: F.array_contains("known", i)))
    counts = saved(known.withColumn("end", F.explode(whole)).drop("known"), "recurring-counts")
    group = ["person_id", "key", "end"]
    starts = counts.groupBy(*group).agg(F.sum("n").alias("c"), F.count_distinct("idx").alias("m"), F.sort_array(F.collect_set("cents")).alias("cents")).where(f"c >= 3 and m = {months}")
    fold = "aggregate(cents, cast(array() as array<bigint>), (s, c) -> if(size(s) = 0 or c - s[size(s) - 1] > greatest(200, (s[size(s) - 1] * 5 + 50) div 100), array_append(s, c), s))"
    starts = starts.select(*group, F.expr(fold).alias("starts"))
    placed = counts.join(starts, group).withColumn("cluster", F.array_max(F.filter("starts", lambda s: s <= F.col("cents")))).drop("starts")
    cluster = [*group, "cluster"]
    first = F.struct("cents", "at")
    days = placed.groupBy(*cluster, "idx").agg(F.dayofmonth(F.min(first)["at"]).alias("day"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("cents")).alias("s1"), F.sum((F.col("n") * F.col("cents") * F.col("cents")).cast("decimal(38,0)")).alias("s2"))
    sums = days.groupBy(*cluster).agg(F.sum("n").alias("n"), F.count("*").alias("m"), F.sum("s1").alias("s1"), F.sum("s2").cast("decimal(38,0)").alias("s2"), (F.max("day") - F.min("day")).alias("spread"))
    mean = F.col("s1") / F.col("n") / 100
    spread = (F.col("n") * F.col("s2") - F.col("s1").cast("decimal(19,0)") * F.col("s1").cast("decimal(19,0)")).cast("double")
    sd = F.sqrt(spread / (F.col("n") * (F.col("n") - 1))) / 100
    good = sums.where((F.col("n") >= 3) & (F.col("m") >= 3) & (F.col("spread") <= 10)).where((mean > 0) & (sd <= F.greatest(F.lit(5.0), 0.08 * mean)))
    # the commonest description, of several the one that comes first by amount and date
    names = placed.where("name <> ''").groupBy(*cluster, "name").agg(F.sum("n").alias("times"), F.min(first).alias("first"))
    labels = names.groupBy(*cluster).agg(F.min(F.struct(-F.col("times"), "first", "name"))["name"].alias("label"))
    found = good.join(labels, cluster, "left")
    return found.select("person_id", "key", month_of_index(F.col("end")).alias("month"), F.coalesce("label", F.lit("Assinatura")).alias("label"), "n", (F.expr("(2 * s1 + n) div (2 * n)") / 100).cast(MONEY).alias("monthly_cost"))


def listed(found: DataFrame, label: str, amount: str, keep: int = 4) -> DataFrame:
    """By person: the number of items, their sum, and the largest as one text with 'and n more'."""
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc(amount), label))
    sums = found.withColumn("r", rank).groupBy("person_id").agg(F.count("*").alias("n"), F.sum(amount).cast(MONEY).alias("total"), F.array_sort(F.collect_list(F.when(F.col("r") <= keep, F.struct("r", F.col(label).alias("label"))))).alias("top"))
    names = F.array_join(F.transform("top", lambda t: t["label"]), ", ")
    return sums.select("person_id", "n", "total", F.concat(names, F.when(F.col("n") > keep, F.concat(F.lit(" and "), (F.col("n") - keep).cast("string"), F.lit(" more"))).otherwise("")).alias("items"))


def trips(tx: DataFrame, words: list[str], days: int = 30, least: int = 4, by: tuple[str, ...] = ("person_id",)) -> DataFrame:
    """The densest stretch of at most so many days with enough travel expenses, per person, or per person and batch where by names
    both; the earliest on ties."""
    best = F.coalesce("purchase_date", "transaction_date")
    some = tx.where((F.col("type") == "EXPENSE") & loose(F.col("description")).rlike(r"\b(" + "|".join(words) + r")\b")).select(*by, best.alias("day"), F.datediff(best, F.lit("1970-01-01").cast("date")).alias("d"))
    ahead = Window.partitionBy(*by).orderBy("d").rangeBetween(0, days)
    spans = some.select(*by, "day", "d", F.count("*").over(ahead).alias("n"), F.max("day").over(ahead).alias("last")).where(F.col("n") >= least)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "d"))
    return spans.withColumn("r", first).where("r = 1").select(*by, F.col("day").alias("trip_start"), F.col("last").alias("trip_end"), F.col("n").alias("candidates"))


def trip_expenses(tx: DataFrame, found: DataFrame, least: int = 4, by: tuple[str, ...] = ("person_id",)) -> DataFrame:
    """Every expense of a person, or of a person's batch, within the trip, where there are enough of them."""
    best = F.coalesce("purchase_date", "transaction_date")
    rows = tx.where("type = 'EXPENSE'").join(found, list(by)).where(best.between(F.col("trip_start"), F.col("trip_end")))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*by))).where(F.col("n") >= least).select(*by, "tx_id", "trip_start", "trip_end", "n")


def volatility(cube: DataFrame, keep: int = 2) -> DataFrame:
    """Categories whose spending varies, over all of a person's active months with 0 for none: mean of
    120 or more, coefficient of variation of 0.35 or more; the two most varying get a budget of 1.1 means."""
    spent = cube.where("type = 'EXPENSE'").groupBy("person_id", "month", "category").agg(F.sum("total_abs").cast(MONEY).alias("total"))
    months = cube.groupBy("person_id").agg(F.count_distinct("month").alias("months"))
    d = F.col("total").cast("double")
    # zero months add nothing to sums, only to their number
    sums = spent.groupBy("person_id", "category").agg(F.sum("total").cast(MONEY).alias("s"), F.sum(d * d).alias("s2")).join(months, "person_id").where("months >= 2")
    mean = F.col("s").cast("double") / F.col("months")
    var = F.greatest((F.col("s2") - F.col("months") * mean * mean) / (F.col("months") - 1), F.lit(0.0))
    out = sums.withColumn("mean", mean).withColumn("cv", F.round(F.sqrt(var) / F.nullif(mean, F.lit(0.0)), 4)).where("mean >= 120 and cv >= 0.35")
    rank = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("cv"), "category"))
    return out.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= keep).select("person_id", "category", F.round("mean", 4).alias("mean"), "cv", F.round(F.col("s") * 11 / (F.col("months") * 10), 2).cast(MONEY).alias("budget"), "rank")


def is_reducible(category: Column, essential: list[str] = ESSENTIAL) -> Column:
    """Whether a category holds none of the words of what is essential, as parts of its name."""
    return ~_holds(normalize(category), essential)


def reducible(rows: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """rows with reducible. words: a table (kind, pattern) of any size with the kind essential, in place of our own few words."""
    if words is None:
        return rows.withColumn("reducible", is_reducible(F.col("category")))
    return word_kinds(rows, words, "category").withColumn("reducible", ~F.array_contains("kinds", "essential")).drop("kinds")


def flag_critical(tx: DataFrame, threshold: float = 5000, risky: list[str] = (), keywords: list[str] = (), enabled: bool = True) -> DataFrame:
    """is_critical with the first reason that holds: high value, risky category (equal), suspicious word
    (contained). Review state stays only where a row stays critical; disabled, all is cleared."""
    text, category = loose(F.coalesce("description", F.lit(""))), loose(F.coalesce("category", F.lit("")))
    word = reduce(lambda a, k: a | text.contains(k), keywords, F.lit(False))
    reason = F.when(F.abs("amount") >= threshold, "HIGH_VALUE").when(category.isin(list(risky) or [""]) & (category != ""), "RISKY_CATEGORY").when(word, "SUSPICIOUS_DESCRIPTION")
    reason = reason if enabled else F.lit(None).cast("string")
    out = tx.withColumn("critical_reason", reason).withColumn("is_critical", F.col("critical_reason").isNotNull())
    reviewed = F.coalesce("critical_reviewed", F.lit(False)) if "critical_reviewed" in tx.columns else F.lit(False)
    return out.withColumn("critical_reviewed", F.col("is_critical") & reviewed)


def unreviewed_critical(tx: DataFrame, reason: str | None = None) -> DataFrame:
    out = tx.where("is_critical and not critical_reviewed and deleted_at is null")
    return (out.where(F.col("critical_reason") == reason) if reason else out).orderBy(F.desc("transaction_date"), "tx_id")


def critical_stats(tx: DataFrame) -> DataFrame:
    """By person: critical rows, unreviewed ones, and a count for each reason that occurs."""
    rows = tx.where("is_critical and deleted_at is null").groupBy("person_id", "critical_reason").agg(F.count("*").alias("n"), F.count_if(~F.col("critical_reviewed")).alias("u"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "critical_reason", F.col("n").cast("string"))))
    return rows.groupBy("person_id").agg(F.sum("n").alias("total"), F.sum("u").alias("unreviewed"), F.array_join(entries, ";").alias("by_reason"))


def default_quality(cube: DataFrame, least: int = 20) -> DataFrame:
    """Person-months whose uncategorised expenses make up so many per cent or more."""
    sums = cube.where("type = 'EXPENSE'").groupBy("person_id", "month").agg(F.sum("total_abs").cast(MONEY).alias("total"), total_if(F.col("category") == DEFAULT_CATEGORY, F.col("total_abs")).alias("uncategorized"))
    return sums.where("total > 0").withColumn("percent", percent(F.col("uncategorized"), F.col("total"))).where(F.col("percent") >= least)


def budget_exceeded(cube: DataFrame, goals: DataFrame, month: str) -> DataFrame:
    """Active goals titled 'Budget: <category>' whose category's spending in a month is above the limit."""
    wanted = goals.where("status = 'ACTIVE'").select("goal_id", F.col("owner_id").alias("person_id"), F.lower(F.trim(F.regexp_extract("title", r"(?i)^budget:\s*(.+)$", 1))).alias("key"), "target_amount").where("key <> ''")
    spent = cube.where((F.col("type") == "EXPENSE") & (F.col("month") == F.lit(month).cast("date"))).groupBy("person_id", F.lower("category").alias("key")).agg(F.sum("total_abs").cast(MONEY).alias("spent"))
    return wanted.join(spent, ["person_id", "key"]).where("spent > target_amount").select("person_id", "goal_id", F.col("key").alias("category"), "spent", F.col("target_amount").alias("limit"), (F.col("spent") - F.col("target_amount")).cast(MONEY).alias("excess"))


def default_examples(tx: DataFrame, keep: int = 3) -> DataFrame:
    """The largest uncategorised descriptions of each person."""
    sums = tx.where((F.col("type") == "EXPENSE") & (category_or_default(F.col("category")) == DEFAULT_CATEGORY)).groupBy("person_id", "description").agg(F.sum(F.abs("amount")).cast(MONEY).alias("spent"))
    return listed(sums, "description", "spent", keep)
