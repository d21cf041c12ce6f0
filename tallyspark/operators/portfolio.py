"""Investments, assets, goals, budgets, billing, audit search, and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import MONEY, ratio_percent, total


def investment_summary(inv: DataFrame) -> DataFrame:
    """Count, values, change and profitability by owner and type; type null: the owner's total."""
    sums = inv.rollup("owner_id", "type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), total(F.col("initial_value")).alias("initial"), total(F.col("current_value")).alias("current")).where("g < 3")
    change = (F.col("current") - F.col("initial")).cast(MONEY)
    return sums.select("owner_id", "type", "n", "initial", "current", change.alias("change"), ratio_percent(change, F.col("initial")).alias("profitability"))


def asset_summary(assets: DataFrame) -> DataFrame:
    return assets.rollup("owner_id", "type").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), total(F.col("current_value")).alias("current")).where("g < 3").drop("g")


def goal_summary(goals: DataFrame) -> DataFrame:
    by = lambda s: F.count_if(F.col("status") == s)
    return goals.groupBy("owner_id").agg(by("ACTIVE").alias("active"), by("COMPLETED").alias("completed"), by("CANCELED").alias("canceled"), total(F.col("target_amount")).alias("target"), total(F.col("current_amount")).alias("current"))


def goal_progress(goals: DataFrame) -> DataFrame:
    """Progress in per cent, 0 where the target isn't positive, and whether it is the owner's main goal: its first."""
    progress = F.when(F.col("target_amount") > 0, F.round(F.col("current_amount") * 100 / F.nullif(F.col("target_amount"), F.lit(0)), 2)).otherwise(0).cast("decimal(19,2)")
    first = F.row_number().over(Window.partitionBy("owner_id").orderBy("created_at", "goal_id")) == 1
    return goals.select("goal_id", "owner_id", progress.alias("progress"), first.alias("is_main"))


def budget_health(b: DataFrame) -> DataFrame:
    """Total, balance and the shares of needs, wants and savings; healthy at 50/30/20; warnings."""
    costs = ["essential_fixed_cost", "necessary_fixed_cost", "variable_fixed_cost", "investment", "planned_purchase", "debt", "protection"]
    col = F.col
    whole = sum((col(c) for c in costs[1:]), col(costs[0])).cast(MONEY)
    needs, wants, saved = col("essential_fixed_cost") + col("necessary_fixed_cost") + col("debt") + col("protection"), col("variable_fixed_cost") + col("planned_purchase"), col("investment")
    out = b.select("owner_id", "income", whole.alias("total"), (col("income") - whole).cast(MONEY).alias("balance"), ratio_percent(needs, col("income")).alias("needs_percent"), ratio_percent(wants, col("income")).alias("wants_percent"), ratio_percent(saved, col("income")).alias("savings_percent"))
    tell = [F.when(col("needs_percent") > 50, "needs above 50"), F.when(col("wants_percent") > 30, "wants above 30"), F.when(col("savings_percent") < 20, "savings below 20"), F.when(col("balance") < 0, "over budget")]
    return out.withColumn("warnings", F.array_join(F.array_compact(F.array(*tell)), ";")).withColumn("healthy", F.col("warnings") == "")


def sync_assets(investments: DataFrame, assets: DataFrame) -> DataFrame:
    """What keeps synced assets equal to investments: insert, update or delete (the investment is gone or excluded)."""
    inv = investments.where("not excluded").select("investment_id", F.col("owner_id").alias("inv_owner"), F.col("current_value").alias("value"))
    own = assets.where("synced").select("asset_id", "investment_id", "current_value")
    joined = own.join(inv, "investment_id", "full_outer")
    action = F.when(F.col("asset_id").isNull(), "insert").when(F.col("inv_owner").isNull(), "delete").when(~F.col("current_value").eqNullSafe(F.col("value")), "update")
    return joined.select("investment_id", "asset_id", "value", action.alias("action")).where("action is not null")


def orphan_assets(investments: DataFrame, assets: DataFrame) -> DataFrame:
    return assets.where("synced").join(investments.where("not excluded").select("investment_id"), "investment_id", "left_anti")


def last_payment(payments: DataFrame) -> DataFrame:
    return payments.where("status = 'APPROVED'").groupBy("user_id").agg(F.max("paid_at").alias("last_paid"))


def billing(users: DataFrame, subscriptions: DataFrame, payments: DataFrame, as_of: str) -> DataFrame:
    """Each user's billing status and days to expiry."""
    today = F.lit(as_of).cast("date")
    subs = subscriptions.withColumnRenamed("status", "sub_status").withColumn("has_sub", F.lit(True))
    status = F.when(F.col("has_sub").isNull(), "NO_SUBSCRIPTION").when(F.col("sub_status") == "CANCELED", "CANCELED").when(F.col("end_date").isNull() | (F.col("end_date") < today), "OVERDUE").otherwise("UP_TO_DATE")
    return users.join(subs, "user_id", "left").join(last_payment(payments), "user_id", "left").withColumn("billing_status", status).withColumn("days_left", F.datediff("end_date", today))


def subscription_alerts(billed: DataFrame, as_of: str, limit: int | None = None) -> DataFrame:
    """Users with alerts: names, and the highest severity (3 critical to 1). A paid plan without a subscription
    is alone; so is a cancelled one that ended. A payment counts as recent within 45 days, for plans of at most
    45 days within their length and 15 more, 60 at most."""
    today = F.lit(as_of).cast("date")
    paid = F.col("plan") != "FREE"
    none = F.col("billing_status") == "NO_SUBSCRIPTION"
    length = F.datediff("end_date", "start_date")
    window = F.when(length <= 45, F.least(F.lit(60), length + 15)).otherwise(45)
    recent = F.coalesce(F.datediff(today, "last_paid") <= window, F.lit(False))
    alert = lambda c, name, level: F.when(c, F.struct(F.lit(name).alias("name"), F.lit(level).alias("level")))
    first = F.when(none & paid, F.array(alert(F.lit(True), "paid plan without subscription", 3)))
    others = F.array_compact(
        F.array(
            alert(F.col("billing_status") == "CANCELED", "canceled", 2),
            alert(F.col("billing_status") == "OVERDUE", "overdue", 3),
            alert(F.col("end_date").isNull() & ~none, "no end date", 2),
            alert(F.col("days_left") <= 7, "expiring soon", 2),
            alert(paid & ~none & F.col("last_paid").isNull(), "never paid", 2),
            alert(paid & ~none & F.col("last_paid").isNotNull() & ~recent, "no recent payment", 1),
        )
    )
    out = billed.withColumn("alerts", F.coalesce(first, F.when(none, F.array().cast("array<struct<name:string,level:int>>")).otherwise(others))).where(F.size("alerts") > 0)
    out = out.withColumn("severity", F.array_max(F.transform("alerts", lambda a: a["level"]))).orderBy(F.desc("severity"), F.asc_nulls_last("days_left"), "user_id")
    return out.limit(limit) if limit else out


def renewal(subscriptions: DataFrame, days: int, as_of: str) -> DataFrame:
    """End dates after so many days more (1 to 3650) from the end, or from as_of where that is past or missing."""
    if not 1 <= days <= 3650:
        raise ValueError("days must be 1 to 3650")
    base = F.greatest(F.coalesce("end_date", F.lit(as_of).cast("date")), F.lit(as_of).cast("date"))
    return subscriptions.select("user_id", "end_date", F.date_add(base, days).alias("renewed_until"))


def search_audit(audit: DataFrame, q: str | None = None, action: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every predicate is optional; q is looked for in four columns without case; both ends count."""
    out = audit
    if start:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    for name, value in (("action", action), ("status", status)):
        if value:
            out = out.where(F.col(name) == value)
    if q:
        out = out.where(sum((F.lower(c).contains(q.lower()).cast("int") for c in ("user_email", "ip", "action", "details")), F.lit(0)) > 0)
    return out


def search_users(users: DataFrame, q: str | None = None, role: str | None = None, status: str | None = None) -> DataFrame:
    out = users
    if q:
        out = out.where(F.lower("email").contains(q.lower()) | F.lower("name").contains(q.lower()))
    for name, value in (("role", role), ("status", status)):
        if value:
            out = out.where(F.col(name) == value)
    return out


def recent_action_counts(audit: DataFrame, since: str) -> DataFrame:
    return audit.where(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("user_id", "action").agg(F.count("*").alias("n"))


def _reasons(**checks: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in checks.items()])), ";")


def validate_transactions(tx: DataFrame) -> DataFrame:
    """The rules that a row breaks, in order; empty where it breaks none."""
    return tx.withColumn("violations", _reasons(
        amount_not_positive=F.coalesce(F.col("amount") <= 0, F.lit(True)),
        due_before_transaction=F.col("due_date") < F.col("transaction_date"),
        paid_before_transaction=F.col("paid_date") < F.col("transaction_date"),
        paid_without_date=(F.col("status") == "PAID") & F.col("paid_date").isNull(),
        date_without_paid=(F.col("status") != "PAID") & F.col("paid_date").isNotNull(),
    ))


def validate_budgets(b: DataFrame) -> DataFrame:
    costs = ["essential_fixed_cost", "necessary_fixed_cost", "variable_fixed_cost", "investment", "planned_purchase", "debt", "protection"]
    return b.withColumn("violations", _reasons(income_not_positive=F.col("income") <= 0, **{f"{c}_negative": F.col(c) < 0 for c in costs}))


def validate_investments(inv: DataFrame) -> DataFrame:
    return inv.withColumn("violations", _reasons(initial_not_positive=F.col("initial_value") <= 0, current_negative=F.col("current_value") < 0))


def validate_goals(goals: DataFrame) -> DataFrame:
    return goals.withColumn("violations", _reasons(target_not_positive=F.col("target_amount") <= 0, current_negative=F.col("current_amount") < 0, title_blank=F.trim("title") == ""))
