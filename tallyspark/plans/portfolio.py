"""Queries: portfolio, budgets, billing, audit, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import portfolio as P
from tallyspark.plans.registry import query
from tallyspark.sources.testdata import AS_OF


def ratio_sql(part: str, whole: str) -> str:
    """part / whole half up at six decimals, times 100, half up at two."""
    p, w = f"CAST(({part}) * 100 AS HUGEINT)", f"CAST(({whole}) * 100 AS HUGEINT)"
    six = f"((2 * abs({p}) * 1000000 + abs({w})) // (2 * abs({w})))"
    return f"CAST(CASE WHEN {whole} = 0 THEN 0 ELSE sign({p}) * sign({w}) * (({six} + 50) // 100) / 100.0 END AS DECIMAL(19,2))"


_INV = "SELECT owner_id, type, count(*) AS n, CAST(sum(initial_value) AS DECIMAL(19,2)) AS initial, CAST(sum(current_value) AS DECIMAL(19,2)) AS current FROM investments GROUP BY GROUPING SETS ((owner_id, type), (owner_id))"


@query("ag13_ag17_investment_summary", "investments", sql=f"SELECT *, CAST(current - initial AS DECIMAL(19,2)) AS change, {ratio_sql('current - initial', 'initial')} AS profitability FROM ({_INV})")
def _(investments):
    return P.investment_summary(investments)


@query("ag13_asset_summary", "assets", sql="SELECT owner_id, type, count(*) AS n, CAST(sum(current_value) AS DECIMAL(19,2)) AS current FROM assets GROUP BY GROUPING SETS ((owner_id, type), (owner_id))")
def _(assets):
    return P.asset_summary(assets)


@query("ag13_goal_summary", "goals", sql="SELECT owner_id, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'CANCELED') AS canceled, CAST(sum(target_amount) AS DECIMAL(19,2)) AS target, CAST(sum(current_amount) AS DECIMAL(19,2)) AS current FROM goals GROUP BY owner_id")
def _(goals):
    return P.goal_summary(goals)


@query("sf17_goal_progress", "goals", sql="SELECT goal_id, owner_id, CAST(CASE WHEN target_amount > 0 THEN (2 * CAST(current_amount * 100 AS HUGEINT) * 10000 + CAST(target_amount * 100 AS HUGEINT)) // (2 * CAST(target_amount * 100 AS HUGEINT)) / 100.0 ELSE 0 END AS DECIMAL(19,2)) AS progress, row_number() OVER (PARTITION BY owner_id ORDER BY created_at, goal_id) = 1 AS is_main FROM goals")
def _(goals):
    return P.goal_progress(goals)


_B = "essential_fixed_cost + necessary_fixed_cost + variable_fixed_cost + investment + planned_purchase + debt + protection"


@query("sf16_budget_health", "budgets", sql=f"""WITH s AS (SELECT owner_id, income, CAST({_B} AS DECIMAL(19,2)) AS total, CAST(income - ({_B}) AS DECIMAL(19,2)) AS balance, {ratio_sql('essential_fixed_cost + necessary_fixed_cost + debt + protection', 'income')} AS needs_percent,
  {ratio_sql('variable_fixed_cost + planned_purchase', 'income')} AS wants_percent, {ratio_sql('investment', 'income')} AS savings_percent FROM budgets),
w AS (SELECT *, concat_ws(';', CASE WHEN needs_percent > 50 THEN 'needs above 50' END, CASE WHEN wants_percent > 30 THEN 'wants above 30' END, CASE WHEN savings_percent < 20 THEN 'savings below 20' END, CASE WHEN balance < 0 THEN 'over budget' END) AS warnings FROM s)
SELECT *, warnings = '' AS healthy FROM w""")
def _(budgets):
    return P.budget_health(budgets)


@query("jn11_sync_assets", "investments", "assets", sql="""WITH i AS (SELECT investment_id, owner_id AS o, current_value AS value FROM investments WHERE NOT excluded), a AS (SELECT asset_id, investment_id, current_value FROM assets WHERE synced),
j AS (SELECT investment_id, asset_id, value, CASE WHEN asset_id IS NULL THEN 'insert' WHEN o IS NULL THEN 'delete' WHEN current_value IS DISTINCT FROM value THEN 'update' END AS action FROM a FULL JOIN i USING (investment_id)) SELECT * FROM j WHERE action IS NOT NULL""")
def _(investments, assets):
    return P.sync_assets(investments, assets)


@query("jn9_orphan_assets", "investments", "assets", sql="SELECT asset_id, investment_id FROM assets WHERE synced AND investment_id NOT IN (SELECT investment_id FROM investments WHERE NOT excluded)")
def _(investments, assets):
    return P.orphan_assets(investments, assets).select("asset_id", "investment_id")


@query("ag14_last_payment", "payments", sql="SELECT user_id, max(paid_at) AS last_paid FROM payments WHERE status = 'APPROVED' GROUP BY user_id")
def _(payments):
    return P.last_payment(payments)


_BILL = f"""WITH l AS (SELECT user_id, max(paid_at) AS last_paid FROM payments WHERE status = 'APPROVED' GROUP BY user_id),
b AS (SELECT u.user_id, plan, s.end_date, s.start_date, last_paid, CASE WHEN s.user_id IS NULL THEN 'NO_SUBSCRIPTION' WHEN s.status = 'CANCELED' THEN 'CANCELED' WHEN s.end_date IS NULL OR s.end_date < DATE '{AS_OF}' THEN 'OVERDUE' ELSE 'UP_TO_DATE' END AS billing_status, CAST(s.end_date - DATE '{AS_OF}' AS INT) AS days_left
  FROM users u LEFT JOIN subscriptions s ON s.user_id = u.user_id LEFT JOIN l ON l.user_id = u.user_id)
"""


@query("jn8_sf18_billing", "users", "subscriptions", "payments", sql=_BILL + "SELECT user_id, billing_status, days_left, last_paid FROM b")
def _(users, subscriptions, payments):
    return P.billing(users, subscriptions, payments, AS_OF).select("user_id", "billing_status", "days_left", "last_paid")


@query("sf19_tk5_subscription_alerts", "users", "subscriptions", "payments", sql=_BILL + f""", a AS (SELECT user_id, days_left, CASE WHEN billing_status = 'NO_SUBSCRIPTION' THEN CASE WHEN plan <> 'FREE' THEN 'paid plan without subscription' ELSE '' END ELSE
  concat_ws(';', CASE WHEN billing_status = 'CANCELED' THEN 'canceled' END, CASE WHEN billing_status = 'OVERDUE' THEN 'overdue' END, CASE WHEN end_date IS NULL THEN 'no end date' END, CASE WHEN days_left <= 7 THEN 'expiring soon' END,
  CASE WHEN plan <> 'FREE' AND last_paid IS NULL THEN 'never paid' END, CASE WHEN plan <> 'FREE' AND last_paid IS NOT NULL AND NOT coalesce(DATE '{AS_OF}' - last_paid <= CASE WHEN end_date - start_date <= 45 THEN least(60, end_date - start_date + 15) ELSE 45 END, false) THEN 'no recent payment' END) END AS alerts FROM b)
SELECT user_id, days_left, alerts, CASE WHEN contains(alerts, 'paid plan') OR contains(alerts, 'overdue') THEN 3 WHEN alerts = 'no recent payment' THEN 1 ELSE 2 END AS severity FROM a WHERE alerts <> ''""")
def _(users, subscriptions, payments):
    found = P.subscription_alerts(P.billing(users, subscriptions, payments, AS_OF), AS_OF)
    return found.select("user_id", "days_left", F.array_join(F.transform("alerts", lambda a: a["name"]), ";").alias("alerts"), "severity")


@query("sf20_renewal", "subscriptions", sql=f"SELECT user_id, end_date, greatest(coalesce(end_date, DATE '{AS_OF}'), DATE '{AS_OF}') + 30 AS renewed_until FROM subscriptions")
def _(subscriptions):
    return P.renewal(subscriptions, 30, AS_OF)


@query("flt3_search_audit", "audit", sql="SELECT event_id, user_id, action FROM audit WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND status = 'SUCCESS' AND (contains(lower(user_email), '1@') OR contains(lower(ip), '1@') OR contains(lower(action), '1@') OR contains(lower(details), '1@'))")
def _(audit):
    return P.search_audit(audit, q="1@", status="SUCCESS", start="2024-01-05 00:00:00", end="2024-01-20 00:00:00").select("event_id", "user_id", "action")


@query("flt4_search_users", "users", sql="SELECT user_id, email FROM users WHERE (contains(lower(email), 'furn') OR contains(lower(name), 'furn')) AND role = 'USER' AND status = 'ACTIVE'")
def _(users):
    return P.search_users(users, q="FURN", role="USER", status="ACTIVE").select("user_id", "email")


@query("ag19_recent_action_counts", "audit", sql="SELECT user_id, action, count(*) AS n FROM audit WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY ALL")
def _(audit):
    return P.recent_action_counts(audit, "2024-01-24 00:00:00")


_V = lambda *c: "concat_ws(';', " + ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in c) + ") AS violations"


@query("flt9_validate_transactions", "tx", sql="SELECT tx_id, " + _V(("amount_not_positive", "amount <= 0"), ("due_before_transaction", "due_date < transaction_date"), ("paid_before_transaction", "purchase_date < transaction_date"), ("paid_without_date", "status = 'PAID' AND purchase_date IS NULL"), ("date_without_paid", "status <> 'PAID' AND purchase_date IS NOT NULL")) + " FROM tx")
def _(tx):
    return P.validate_transactions(tx.withColumn("paid_date", F.col("purchase_date"))).select("tx_id", "violations")


@query("flt9_validate_budgets", "budgets", sql="SELECT owner_id, " + _V(("income_not_positive", "income <= 0"), ("investment_negative", "investment < 0")) + " FROM budgets")
def _(budgets):
    return P.validate_budgets(budgets).select("owner_id", "violations")


@query("flt9_validate_goals", "goals", sql="SELECT goal_id, " + _V(("target_not_positive", "target_amount <= 0"), ("current_negative", "current_amount < 0"), ("title_blank", "trim(title) = ''")) + " FROM goals")
def _(goals):
    return P.validate_goals(goals).select("goal_id", "violations")


@query("flt9_validate_investments", "investments", sql="SELECT investment_id, " + _V(("initial_not_positive", "initial_value <= 0"), ("current_negative", "current_value < 0")) + " FROM investments")
def _(investments):
    return P.validate_investments(investments).select("investment_id", "violations")
