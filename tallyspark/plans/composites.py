"""Queries: scores, insights, goals, reports, upload ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.shared import clustered, new_folder
from tallyspark.operators import composites as C
from tallyspark.operators import invoicing
from tallyspark.operators.summaries import base_cube, cashflow, live
from tallyspark.plans.classifying import _FEED, _MERCH, _RULES, _WORDS
from tallyspark.plans.detection import _RECURRING, _VOLATILE
from tallyspark.plans.ingesting import _INV, _invoice_docs, _layouts
from tallyspark.plans.registry import pct_sql, query
from tallyspark.plans.summaries import CUBE, statement_rules
from tallyspark.sources.testdata import AS_OF
from tallyspark.sources.texts import write_scores

MONTH = "2000-06-01"
_FLOW = """flow AS (SELECT person_id, description, amount, type, transaction_date FROM tx WHERE deleted_at IS NULL UNION ALL SELECT user_id, description, amount, CASE WHEN type = 'CREDIT' THEN 'INCOME' ELSE 'EXPENSE' END, transaction_date FROM stx WHERE type <> 'BALANCE')
"""
_OWN = "own AS (SELECT i.*, c.owner_id FROM invoices i JOIN cards c ON c.card_id = i.card_id WHERE deleted_at IS NULL)"


@query("sc1_ag16_wn11_health_scores", "persons", "tx", "cards", "invoices", sql=f"""WITH {_OWN},
u AS (SELECT l.owner_id, CASE WHEN billed IS NULL OR lim <= 0 THEN 100 WHEN p <= 30 THEN 100 WHEN p <= 50 THEN 90 WHEN p <= 70 THEN 70 WHEN p <= 90 THEN 50 ELSE 20 END AS utilization FROM
  (SELECT owner_id, sum(limit_amount) AS lim FROM cards GROUP BY 1) l LEFT JOIN (SELECT owner_id, billed FROM (SELECT owner_id, year * 12 + month AS idx, sum(total_amount) AS billed FROM own GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY idx DESC) = 1) b USING (owner_id),
  LATERAL (SELECT round(CAST(billed AS DOUBLE) * 100 / CAST(lim AS DOUBLE), 2) AS p)),
o AS (SELECT owner_id, CASE WHEN s >= 100 THEN 100 WHEN s >= 90 THEN 90 WHEN s >= 80 THEN 70 WHEN s >= 70 THEN 50 ELSE 20 END AS on_time FROM (SELECT owner_id, count(*) FILTER (status = 'PAID' AND paid_date <= due_date) * 100.0 / count(*) AS s FROM own WHERE due_date < DATE '{AS_OF}' AND status <> 'OPEN' GROUP BY 1)),
d AS (SELECT person_id, CASE WHEN n >= 8 THEN 100 WHEN n >= 6 THEN 80 WHEN n >= 4 THEN 60 WHEN n >= 2 THEN 40 ELSE 20 END AS diversity FROM (SELECT person_id, count(DISTINCT nullif(lower(trim(category)), '')) AS n FROM tx WHERE deleted_at IS NULL AND type = 'EXPENSE' AND transaction_date BETWEEN DATE '{AS_OF}' - 90 AND DATE '{AS_OF}' GROUP BY 1)),
m AS (SELECT person_id, month(transaction_date) AS mo, CAST(sum(abs(amount)) AS DOUBLE) AS t FROM tx WHERE deleted_at IS NULL AND type = 'EXPENSE' AND transaction_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30' GROUP BY ALL),
g AS (SELECT person_id, coalesce(t, 0) AS t FROM (SELECT DISTINCT person_id FROM m) p CROSS JOIN (SELECT unnest([4, 5, 6]) AS mo) k LEFT JOIN m USING (person_id, mo)),
c AS (SELECT person_id, CASE WHEN r < 10 THEN 100 WHEN r < 20 THEN 80 WHEN r < 30 THEN 60 WHEN r < 40 THEN 40 ELSE 20 END AS consistency FROM (SELECT person_id, round(stddev_pop(t) / avg(t) * 100, 6) AS r FROM g GROUP BY 1)),
h AS (SELECT owner_id, CASE WHEN y > 5 THEN 100 WHEN y >= 3 THEN 90 WHEN y >= 1 THEN 70 WHEN y >= 0.5 THEN 50 ELSE 20 END AS history FROM (SELECT owner_id, (DATE '{AS_OF}' - min(due_date)) / 365.25 AS y FROM own GROUP BY 1)),
w AS (SELECT p.person_id, CAST(coalesce(utilization, 100) AS INT) AS utilization, CAST(coalesce(on_time, 100) AS INT) AS on_time, CAST(coalesce(diversity, 20) AS INT) AS diversity, CAST(coalesce(consistency, 100) AS INT) AS consistency, CAST(coalesce(history, 20) AS INT) AS history
  FROM persons p LEFT JOIN u ON u.owner_id = p.person_id LEFT JOIN o ON o.owner_id = p.person_id LEFT JOIN d ON d.person_id = p.person_id LEFT JOIN c ON c.person_id = p.person_id LEFT JOIN h ON h.owner_id = p.person_id)
SELECT *, CAST((utilization * 25 + on_time * 25 + diversity * 20 + consistency * 15 + history * 15 + 50) // 100 AS INT) AS score FROM w""")
def _(persons, tx, cards, invoices):
    return C.health_scores(persons, tx, cards, invoices, AS_OF)


@query("in1_cashflow_insight", "tx", "stx", sql=f"""WITH {_FLOW}, s AS (SELECT person_id, CAST(coalesce(sum(abs(amount)) FILTER (type = 'INCOME'), 0) - coalesce(sum(abs(amount)) FILTER (type = 'EXPENSE'), 0) AS DECIMAL(19,2)) AS b, sum(abs(amount)) AS a FROM flow WHERE transaction_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30' GROUP BY 1)
SELECT person_id, CASE WHEN b < 0 THEN 'warning' ELSE 'info' END AS type, 'balance ' || b AS message FROM s WHERE a > 0""")
def _(tx, stx):
    return C.cashflow_insight(cashflow(tx, stx), MONTH).select("person_id", "type", "message")


@query("in7_credit_limit", "cards", "invoices", sql="""WITH n AS (SELECT card_id, CAST(sum(total_amount) AS DECIMAL(19,2)) AS billed FROM invoices WHERE year = 2000 AND month = 6 AND deleted_at IS NULL GROUP BY 1),
u AS (SELECT owner_id AS person_id, n.card_id, billed, limit_amount, CAST((2 * CAST(billed * 100 AS HUGEINT) * 100 + CAST(limit_amount * 100 AS HUGEINT)) // (2 * CAST(limit_amount * 100 AS HUGEINT)) AS DECIMAL(19,2)) AS used FROM n JOIN cards c ON c.card_id = n.card_id WHERE limit_amount > 0)
SELECT * FROM u WHERE used > 80""")
def _(cards, invoices):
    return C.credit_limit_usage(cards, invoices, MONTH)


@query("in3_uncategorised", "tx", sql=CUBE + """, s AS (SELECT person_id, month, CAST(sum(total_abs) AS DECIMAL(19,2)) AS total, CAST(coalesce(sum(total_abs) FILTER (category = 'Outros'), 0) AS DECIMAL(19,2)) AS uncategorized FROM cube WHERE type = 'EXPENSE' GROUP BY ALL),
p AS (SELECT *, CAST(((2 * CAST(uncategorized * 100 AS HUGEINT) * 10000 + CAST(total * 100 AS HUGEINT)) // (2 * CAST(total * 100 AS HUGEINT))) / 100.0 AS DECIMAL(19,2)) AS percent FROM s WHERE total > 0) SELECT * FROM p WHERE percent >= 20""")
def _(tx):
    from tallyspark.operators.detection import default_quality

    return default_quality(base_cube(tx))


def _inputs(tx, stx, cards, invoices, goals):
    flow = cashflow(tx, stx)
    return {"cube": base_cube(tx), "flow": flow, "cards": cards, "invoices": invoices, "goals": goals, "as_of": AS_OF}


# All live rows and the mapped statement rows, as a table that the SQL of single operators can read.
_ALL = """allrows AS (SELECT tx_id, person_id, description, amount, type, category, transaction_date, deleted_at FROM recurring WHERE deleted_at IS NULL
  UNION ALL SELECT 's' || stx_id, user_id, description, amount, CASE WHEN type = 'CREDIT' THEN 'INCOME' ELSE 'EXPENSE' END, CASE WHEN type = 'CREDIT' AND contains(description, 'URGENT') THEN 'Renda' WHEN contains(description, 'HIGH') OR contains(description, 'URGENT') THEN 'Moradia' WHEN type = 'DEBIT' AND contains(description, 'MEDIUM') THEN 'Utilidades' ELSE 'Outros' END, transaction_date, NULL
  FROM stx WHERE type <> 'BALANCE' AND transaction_date IS NOT NULL AND trim(description) <> '')
"""
_JUNE = CUBE.replace("WITH ", "", 1).replace("FROM tx ", "FROM recurring ")
_CENTS = "CAST({} * 100 AS HUGEINT)"


def _halves(part: str, whole: str) -> str:
    """100 * part / whole, half up, in whole per cent; for amounts in cents."""
    return f"CAST(sign({part}) * ((2 * abs({part}) * 100 + {whole}) // (2 * {whole})) AS DECIMAL(19,2))"


_INSIGHTS = f"""WITH RECURSIVE {_ALL}, {_JUNE}, {_RECURRING.replace("WITH RECURSIVE ", "", 1).replace("FROM recurring ", "FROM allrows ")},
spent AS (SELECT person_id, month, category, CAST(sum(total_abs) AS DECIMAL(19,2)) AS total, year(month) * 12 + month(month) AS idx FROM cube WHERE type = 'EXPENSE' GROUP BY ALL),
months AS (SELECT person_id, month, idx, CAST(sum(total) AS DECIMAL(19,2)) AS total, CAST(coalesce(sum(total) FILTER (category = 'Outros'), 0) AS DECIMAL(19,2)) AS other FROM spent GROUP BY ALL),
flows AS (SELECT person_id, CAST(coalesce(sum(abs(amount)) FILTER (type = 'INCOME'), 0) - coalesce(sum(abs(amount)) FILTER (type = 'EXPENSE'), 0) AS DECIMAL(19,2)) AS balance, sum(abs(amount)) AS moved FROM allrows WHERE transaction_date BETWEEN DATE '{MONTH}' AND DATE '{AS_OF}' GROUP BY 1),
tops AS (SELECT spent.*, months.total AS whole FROM spent JOIN months ON months.person_id = spent.person_id AND months.month = spent.month WHERE spent.month = DATE '{MONTH}' QUALIFY row_number() OVER (PARTITION BY spent.person_id ORDER BY spent.total DESC, category) = 1),
shares AS (SELECT person_id, {pct_sql('other', 'total')} AS percent FROM months WHERE month = DATE '{MONTH}' AND total > 0),
grown AS (SELECT x.person_id, {_halves(_CENTS.format("(x.total - y.total)"), _CENTS.format("y.total"))} AS growth FROM months x JOIN months y ON x.person_id = y.person_id AND x.idx = y.idx + 1 WHERE y.total > 0 AND x.month = DATE '{MONTH}'),
past AS (SELECT x.person_id, x.category, any_value(x.total) AS total, CAST(any_value(x.total) AS DOUBLE) AS v, avg(CAST(y.total AS DOUBLE)) AS mean, coalesce(stddev_samp(CAST(y.total AS DOUBLE)), 0) AS sd FROM spent x JOIN spent y ON y.person_id = x.person_id AND y.category = x.category AND y.idx BETWEEN x.idx - 3 AND x.idx - 1 WHERE x.month = DATE '{MONTH}' AND y.total > 0 GROUP BY x.person_id, x.category HAVING count(*) >= 2),
odd AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY round(v - mean, 4) DESC, category) AS rank FROM past WHERE v > CASE WHEN sd = 0 THEN 1.75 * mean ELSE mean + 2 * sd END AND v > 1.35 * mean AND v - mean > 50),
listed AS (SELECT person_id, count(*) AS items, CAST(sum(monthly_cost) AS DECIMAL(19,2)) AS total, string_agg(label, ', ' ORDER BY place) FILTER (place <= 4) AS names FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY monthly_cost DESC, label) AS place FROM found) GROUP BY 1),
billed AS (SELECT card_id, CAST(sum(total_amount) AS DECIMAL(19,2)) AS billed FROM invoices WHERE year = 2000 AND month = 6 AND deleted_at IS NULL GROUP BY 1),
used AS (SELECT owner_id AS person_id, billed.card_id, {_halves(_CENTS.format("billed"), _CENTS.format("limit_amount"))} AS used FROM billed JOIN cards ON cards.card_id = billed.card_id WHERE limit_amount > 0),
limits AS (SELECT goal_id, owner_id AS person_id, lower(trim(regexp_extract(title, '(?i)^budget:\\s*(.+)$', 1))) AS wanted, target_amount FROM goals WHERE status = 'ACTIVE'),
over AS (SELECT limits.person_id, wanted, CAST(sum(total) - any_value(target_amount) AS DECIMAL(19,2)) AS excess, goal_id FROM limits JOIN spent ON spent.person_id = limits.person_id AND lower(category) = wanted AND month = DATE '{MONTH}' GROUP BY limits.person_id, wanted, goal_id),
said AS (SELECT person_id, 5 AS ord, 1 AS rank, CASE WHEN balance < 0 THEN 'warning' ELSE 'info' END AS type, 'Cashflow' AS category, 'balance ' || balance AS message FROM flows WHERE moved > 0
  UNION ALL SELECT person_id, 10, 1, 'info', category, 'share ' || {pct_sql('total', 'whole', 1)} FROM tops WHERE whole > 0
  UNION ALL SELECT person_id, 11, 1, 'warning', 'Outros', 'share ' || percent FROM shares WHERE percent >= 20
  UNION ALL SELECT person_id, 20, 1, 'warning', 'Growth', 'growth ' || growth FROM grown WHERE growth > 10
  UNION ALL SELECT person_id, 30, rank, CASE WHEN v > 2 * mean THEN 'alert' ELSE 'warning' END, category, 'unusual ' || total FROM odd WHERE rank <= 3
  UNION ALL SELECT person_id, 40, 1, 'info', 'Assinaturas', items || ' recurring: ' || names || CASE WHEN items > 4 THEN ' and ' || (items - 4) || ' more' ELSE '' END || ', ' || total FROM listed
  UNION ALL SELECT person_id, 50, row_number() OVER (PARTITION BY person_id ORDER BY used DESC, card_id), 'warning', 'Credit', 'used ' || used FROM used WHERE used > 80
  UNION ALL SELECT person_id, 60, 1, 'alert', wanted, 'over by ' || excess FROM over WHERE excess > 0 QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY excess DESC, goal_id) = 1),
fresh AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY person_id, lower(trim(category)), lower(trim(message)) ORDER BY ord, rank) = 1)
SELECT person_id, ord, CAST(rank AS BIGINT) AS rank, type, category, message, row_number() OVER (PARTITION BY person_id ORDER BY ord, rank, category, message) AS place FROM fresh QUALIFY place <= 5"""


@query("in_tk4_so3_so6_insights", "recurring", "stx", "cards", "invoices", "goals", sql=_INSIGHTS)
def _(tx, stx, cards, invoices, goals):
    return C.insights(_inputs(tx, stx, cards, invoices, goals), MONTH)


_AVG = f"""WITH r AS (SELECT * FROM tx WHERE deleted_at IS NULL AND transaction_date BETWEEN DATE '2000-03-01' AND DATE '{AS_OF}'),
s AS (SELECT person_id, coalesce(sum(abs(amount)) FILTER (type = 'INCOME'), 0) AS i, coalesce(sum(abs(amount)) FILTER (type = 'EXPENSE'), 0) AS e, greatest(3, least(6, count(DISTINCT month(transaction_date)))) AS n FROM r GROUP BY 1),
a AS (SELECT person_id, n, (2 * CAST(i * 100 AS HUGEINT) + n) // (2 * n) AS income, (2 * CAST(e * 100 AS HUGEINT) + n) // (2 * n) AS expenses FROM s)
"""


_EMERGENCY = """g AS (SELECT person_id, expenses * CASE WHEN income * 10 >= expenses * 12 THEN 6 ELSE 3 END AS target, greatest(5000, CASE WHEN income > 0 THEN (2 * income + 10) // 20 ELSE (2 * expenses + 20) // 40 END) AS monthly FROM a WHERE expenses >= 50000)
SELECT person_id, CAST(1 AS INT) AS priority, 'Emergency fund' AS title, CAST(target / 100.0 AS DECIMAL(19,2)) AS target, CAST(monthly / 100.0 AS DECIMAL(19,2)) AS monthly, CAST(greatest(6, least(24, ((2 * target * 1000000 + monthly) // (2 * monthly) + 999999) // 1000000)) AS INT) AS months FROM g"""


@query("go1_emergency_fund", "tx", sql=f"{_AVG}, {_EMERGENCY}")
def _(tx):
    return C.emergency_fund(C._recent(live(tx), AS_OF))


_DEBT = """o AS (SELECT owner_id AS person_id, sum(greatest(total_amount - paid_amount, 0)) AS debt FROM invoices i JOIN cards c ON c.card_id = i.card_id WHERE deleted_at IS NULL AND status = 'OPEN' GROUP BY 1 HAVING sum(greatest(total_amount - paid_amount, 0)) >= 500),
j AS (SELECT o.person_id, CAST(debt * 100 AS HUGEINT) AS debt, (2 * CAST(debt * 100 AS HUGEINT) + 6) // 12 AS base, coalesce(income, 0) - coalesce(expenses, 0) AS surplus FROM o LEFT JOIN a ON a.person_id = o.person_id),
g AS (SELECT *, greatest(CASE WHEN surplus > 0 THEN least(2 * base, surplus) ELSE 2 * base END, 30000) AS twice FROM j)
SELECT person_id, CAST(2 AS INT) AS priority, 'Pay off debt' AS title, CAST(debt / 100.0 AS DECIMAL(19,2)) AS target, CAST(((twice + 1) // 2) / 100.0 AS DECIMAL(19,2)) AS monthly, CAST(greatest(3, least(24, ((4 * debt * 1000000 + twice) // (2 * twice) + 999999) // 1000000)) AS INT) AS months FROM g"""


@query("go2_debt_payoff", "tx", "invoices", "cards", sql=f"{_AVG}, {_DEBT}")
def _(tx, invoices, cards):
    return C.debt_payoff(C._recent(live(tx), AS_OF), invoicing.outstanding_debt(invoices, cards))


_REDUCIBLE = """c AS (SELECT person_id, coalesce(nullif(trim(category), ''), 'Outros') AS category, sum(abs(amount)) AS spent FROM r WHERE type = 'EXPENSE' GROUP BY ALL),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY spent DESC, category) = 1), k AS (SELECT t.person_id, category, (2 * CAST(spent * 100 AS HUGEINT) + n) // (2 * n) AS average FROM t JOIN a ON a.person_id = t.person_id),
g AS (SELECT *, (2 * average * 9 + 10) // 20 AS goal FROM k)
SELECT person_id, CAST(3 AS INT) AS priority, 'Reduce ' || category AS title, CAST(goal / 100.0 AS DECIMAL(19,2)) AS target, CAST((average - goal) / 100.0 AS DECIMAL(19,2)) AS monthly, CAST(3 AS INT) AS months FROM g WHERE average >= 15000 AND average - goal >= 3000"""


@query("go3_reducible_spending", "tx", sql=f"{_AVG}, {_REDUCIBLE}")
def _(tx):
    return C.reducible_spending(C._recent(live(tx), AS_OF))


_CLEANUP = """k AS (SELECT person_id, trim(regexp_replace(regexp_replace(lower(description), '[0-9]', '', 'g'), '[^a-z]+', ' ', 'g')) AS key, sum(abs(amount)) AS s FROM recurring WHERE deleted_at IS NULL AND type = 'EXPENSE' AND abs(amount) >= 8 AND contains(description, 'plan') AND transaction_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30' GROUP BY ALL HAVING count(DISTINCT month(transaction_date)) = 3),
c AS (SELECT person_id, (2 * CAST(s * 100 AS HUGEINT) + 3) // 6 AS cost FROM k), g AS (SELECT person_id, sum(cost) AS t FROM c GROUP BY 1 HAVING count(*) >= 1 AND sum(cost) >= 3000)
SELECT person_id, CAST(3 AS INT) AS priority, 'Clean up subscriptions' AS title, CAST(t / 100.0 AS DECIMAL(19,2)) AS target, CAST(t / 100.0 AS DECIMAL(19,2)) AS monthly, CAST(1 AS INT) AS months FROM g"""


@query("go4_subscription_cleanup", "recurring", sql=f"WITH {_CLEANUP}")
def _(tx):
    return C.subscription_cleanup(live(tx), AS_OF, least_keys=1)


@query("go5_budget_optimization", "tx_dense", sql=_VOLATILE + "SELECT person_id, CAST(4 AS INT) AS priority, 'Budget: ' || category AS title, budget AS target, budget AS monthly, CAST(3 AS INT) AS months FROM volatile")
def _(tx):
    return C.budget_optimization(base_cube(tx))


_ESSENTIAL = "moradia|aluguel|saude|educacao|housing|health|education|rent"
_GOALS = f"""WITH {_ALL}, {_AVG.replace("WITH ", "", 1).replace("FROM tx ", "FROM allrows ")},
suggested AS (SELECT * FROM (WITH {_EMERGENCY}) UNION ALL SELECT * FROM (WITH {_DEBT})
  UNION ALL SELECT * FROM (WITH {_REDUCIBLE.replace("GROUP BY ALL)", f"AND NOT regexp_matches(lower(coalesce(category, '')), '{_ESSENTIAL}') GROUP BY ALL)", 1)})
  UNION ALL SELECT * FROM (WITH {_CLEANUP.replace("FROM recurring ", "FROM allrows ").replace("HAVING count(*) >= 1", "HAVING count(*) >= 3")})
  UNION ALL SELECT * FROM ({_VOLATILE.replace("FROM tx_dense ", "FROM recurring ")} SELECT person_id, 4, 'Budget: ' || category, budget, budget, 3 FROM volatile)),
active AS (SELECT owner_id AS person_id, lower(trim(title)) AS t FROM goals WHERE status = 'ACTIVE'),
fresh AS (SELECT s.*, lower(trim(title)) AS t FROM suggested s WHERE NOT EXISTS (SELECT 1 FROM active WHERE active.person_id = s.person_id AND active.t = lower(trim(s.title))) QUALIFY row_number() OVER (PARTITION BY s.person_id, lower(trim(title)) ORDER BY priority, target) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY priority, starts_with(t, 'clean'), target, t) AS place FROM fresh)
SELECT p.person_id, priority, title, target, monthly, months, place FROM placed p LEFT JOIN (SELECT person_id, count(*) AS n FROM active GROUP BY 1) a ON a.person_id = p.person_id WHERE place <= 4 - coalesce(n, 0)"""


@query("go_so4_generate_goals", "recurring", "stx", "invoices", "cards", "goals", sql=_GOALS)
def _(tx, stx, invoices, cards, goals):
    flow = cashflow(tx, stx, statement_rules(tx))
    return C.generate_goals(flow, base_cube(tx), invoicing.outstanding_debt(invoices, cards), goals, AS_OF)


@query("so4_fill_goals", "goals", "budgets", sql="""WITH s AS (SELECT owner_id AS person_id, priority, title, CAST(100 * priority AS DECIMAL(19,2)) AS target FROM budgets CROSS JOIN (VALUES (1, 'emergency fund'), (2, 'Pay off debt'), (2, 'pay off debt '), (4, 'Budget: x')) v(priority, title)),
act AS (SELECT owner_id AS person_id, lower(trim(title)) AS t FROM goals WHERE status = 'ACTIVE'),
f AS (SELECT s.*, lower(trim(title)) AS t FROM s WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.person_id = s.person_id AND act.t = lower(trim(s.title)))),
o AS (SELECT person_id, priority, t, min(target) AS target FROM f GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY priority, target, t) AS place FROM o) SELECT p.person_id, CAST(priority AS INT) AS priority, t, place FROM p LEFT JOIN (SELECT person_id, count(*) AS n FROM act GROUP BY 1) a ON a.person_id = p.person_id WHERE place <= 4 - coalesce(n, 0)""")
def _(goals, budgets):
    titles = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(t).alias("title")) for p, t in ((1, "emergency fund"), (2, "Pay off debt"), (2, "pay off debt "), (4, "Budget: x"))])
    s = budgets.select(F.col("owner_id").alias("person_id"), F.inline(titles)).withColumn("target", (F.col("priority") * 100).cast("decimal(19,2)")).withColumn("monthly", F.col("target")).withColumn("months", F.lit(3))
    return C.fill_goals(s, goals).select("person_id", "priority", F.lower(F.trim("title")).alias("t"), "place")


_CHANGE = "CAST(coalesce(sum(abs(amount)) FILTER (type = '{}'), 0) AS DECIMAL(19,2))"


@query("rp1_snk1_sf21_reports", "tx", "investments", "budgets", "assets", "goals", "stx", "statements", "cards", "invoices", sql=CUBE + f""", p AS (SELECT person_id, CAST(date_trunc('year', transaction_date) AS DATE) AS period_start, {_CHANGE.format('INCOME')} AS income, {_CHANGE.format('EXPENSE')} AS expenses,
  count(DISTINCT type || coalesce(nullif(trim(category), ''), 'Outros')) AS n_parts FROM tx WHERE deleted_at IS NULL GROUP BY ALL),
i AS (SELECT owner_id, CAST(sum(current_value) AS DECIMAL(19,2)) AS invested FROM investments GROUP BY 1), a AS (SELECT owner_id, count(*) AS n_assets, CAST(sum(current_value) AS DECIMAL(19,2)) AS assets FROM assets GROUP BY 1),
g AS (SELECT owner_id, count(*) FILTER (status = 'ACTIVE') AS active_goals, CAST(sum(target_amount) AS DECIMAL(19,2)) AS goal_target FROM goals GROUP BY 1),
s AS (SELECT user_id, CAST(date_trunc('year', transaction_date) AS DATE) AS period_start, CAST(coalesce(sum(abs(amount)) FILTER (type = 'CREDIT'), 0) AS DECIMAL(19,2)) AS credits, CAST(coalesce(sum(CASE WHEN type = 'CREDIT' THEN abs(amount) WHEN type <> 'BALANCE' THEN -abs(amount) END), 0) AS DECIMAL(19,2)) AS statement_balance, count(*) AS n_statements, least(count(*), 200) AS listed, arg_min(stx_id, {{'d': transaction_date, 'i': stx_id}}) AS first_listed FROM stx GROUP BY ALL),
v AS (SELECT user_id, CAST(date_trunc('year', statement_date) AS DATE) AS period_start, arg_min(opening_balance, statement_date) AS opening, arg_max(closing_balance, statement_date) AS closing FROM statements GROUP BY ALL),
m AS (SELECT person_id, month, category, CAST(sum(total_abs) AS DECIMAL(19,2)) AS total FROM cube WHERE type = 'EXPENSE' GROUP BY ALL),
t AS (SELECT person_id, month, category AS top_category FROM (SELECT *, sum(total) OVER (PARTITION BY person_id, month) AS whole, row_number() OVER (PARTITION BY person_id, month ORDER BY total DESC, category) AS r FROM m) WHERE r = 1 AND whole > 0)
SELECT p.person_id, 'ANNUAL' AS report_type, p.period_start, 'Annual report ' || year(p.period_start) || '-01-01 to ' || year(p.period_start) || '-12-31' AS title, p.income, p.expenses, CAST(coalesce(q.income, 0) AS DECIMAL(19,2)) AS previous_income, CAST(p.expenses - coalesce(q.expenses, 0) AS DECIMAL(19,2)) AS expense_change, p.n_parts,
  invested, n_assets, assets, active_goals, goal_target, credits, n_statements, statement_balance, listed, first_listed, CASE WHEN s.user_id IS NOT NULL THEN opening END AS opening, CASE WHEN s.user_id IS NOT NULL THEN closing END AS closing, top_category, b.owner_id IS NOT NULL AS has_budget
FROM p LEFT JOIN p q ON q.person_id = p.person_id AND year(q.period_start) = year(p.period_start) - 1 LEFT JOIN i ON i.owner_id = p.person_id LEFT JOIN a ON a.owner_id = p.person_id LEFT JOIN g ON g.owner_id = p.person_id LEFT JOIN budgets b ON b.owner_id = p.person_id
  LEFT JOIN s ON s.user_id = p.person_id AND s.period_start = p.period_start LEFT JOIN v ON v.user_id = p.person_id AND v.period_start = p.period_start LEFT JOIN t ON t.person_id = p.person_id AND year(t.month) = year(p.period_start) AND month(t.month) = 12""")
def _(tx, investments, budgets, assets, goals, stx, statements, cards, invoices):
    r = C.period_reports(tx, "ANNUAL", investments, budgets, assets, goals, stx, statements, cards, invoices)
    m = "decimal(19,2)"
    doc = F.from_json("data", f"title string, summary struct<income {m}, expenses {m}, previous_income {m}, expense_change {m}>, breakdown array<struct<type string>>, investments struct<current {m}>, assets struct<n bigint, current {m}>, goals struct<active bigint, target {m}>, budget struct<total {m}>, statements struct<credits {m}, n bigint, balance {m}, opening {m}, closing {m}, rows array<struct<stx_id bigint>>>, insights array<struct<ord int, category string>>")
    d = lambda x: F.col(f"d.{x}")
    top = F.get(F.filter(d("insights"), lambda i: i["ord"] == 10), F.lit(0))["category"]
    return r.withColumn("d", doc).select(
        "person_id", "report_type", "period_start", d("title"), d("summary.income"), d("summary.expenses"), d("summary.previous_income"), d("summary.expense_change"), F.size(d("breakdown")).cast("bigint").alias("n_parts"), d("investments.current").alias("invested"),
        d("assets.n").alias("n_assets"), d("assets.current").alias("assets"), d("goals.active").alias("active_goals"), d("goals.target").alias("goal_target"), d("statements.credits"), d("statements.n").alias("n_statements"), d("statements.balance").alias("statement_balance"), F.when(d("statements").isNotNull(), F.size(d("statements.rows"))).cast("bigint").alias("listed"), F.get(d("statements.rows"), F.lit(0))["stx_id"].alias("first_listed"), d("statements.opening"), d("statements.closing"), top.alias("top_category"), d("budget").isNotNull().alias("has_budget"),
    )


@query("rp1_report_insights", "recurring", "stx", "cards", "invoices", "goals", sql=_INSIGHTS)
def _(tx, stx, cards, invoices, goals):
    """A report's insights as of one month are those of the dashboard."""
    cube = clustered(base_cube(tx), "insights-cube", "person_id")
    found = C.monthly_insights(cube, cashflow(tx, stx), cards, invoices, goals).where(F.col("month") == F.lit(MONTH).cast("date"))
    return found.select("person_id", F.posexplode("insights").alias("place", "i")).select("person_id", "i.*", (F.col("place") + 1).cast("bigint").alias("place"))


# Uploads name a card of the owner, whose brand is stored in capitals, and a new one under two names.
_UP = """WITH c AS (SELECT owner_id, min(card_id) FILTER (card_id % 2 = 0) AS card_id FROM cards GROUP BY 1),
g0 AS (SELECT p.doc_id, p.line_no, p.description, p.amount, p.type, p.date, p.due_date, p.person_id, p.installment_number, p.document_total, CASE line_no % 3 WHEN 1 THEN 'Visa ' || lpad(CAST(person_id % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN 'Elo 99999' ELSE 'gold elo 9999' END AS card_name, CASE WHEN line_no % 5 = 0 THEN 'Own' WHEN line_no % 5 = 1 THEN ' outros ' END AS own_category
  FROM parsed p WHERE p.date IS NOT NULL AND p.amount > 0),
e AS (SELECT person_id, 'new|' || person_id || '|elo|9999|' || arg_min(card_name, {'d': doc_id, 'l': line_no}) AS elo_key FROM g0 WHERE line_no % 3 <> 1 GROUP BY person_id),
made AS (SELECT concat_ws('-', doc_id, line_no, description, amount, card_name) AS tx_id, doc_id, line_no, g0.person_id, description, amount, type, coalesce(due_date, date) AS transaction_date, date AS purchase_date, document_total, card_name,
  CASE WHEN line_no % 3 = 1 THEN CAST(card_id AS VARCHAR) ELSE elo_key END AS card_key, coalesce(installment_number, 1) AS number, own_category FROM g0 LEFT JOIN e ON e.person_id = g0.person_id LEFT JOIN c ON c.owner_id = g0.person_id),
added AS (SELECT doc_id, card_key, CAST(year(transaction_date) AS INT) AS year, CAST(month(transaction_date) AS INT) AS month, sum(CASE WHEN type = 'EXPENSE' THEN amount ELSE -amount END) AS added, max(transaction_date) AS new_due, max(document_total) AS stated FROM made GROUP BY ALL),
alone AS (SELECT doc_id FROM added GROUP BY doc_id HAVING count(*) = 1 AND max(stated) > 0)
"""
_UP_VIEWS = ("parsed", "rules", "feedback", "tx", "dictionary", "keywords", "invoices", "cards")


def _ingested(part: str, parsed, rules, feedback, tx, dictionary, keywords, invoices, cards):
    c, digits = F.col, lambda x: F.lpad((x % 10000).cast("string"), 4, "0")
    name = F.when(c("line_no") % 3 == 1, F.concat(F.lit("Visa "), digits(c("person_id")))).when(c("line_no") % 3 == 2, "Elo 99999").otherwise("gold elo 9999")
    uploads = parsed.withColumn("card_name", name).withColumn("category", F.when(c("line_no") % 5 == 0, "Own").when(c("line_no") % 5 == 1, " outros "))
    known = cards.withColumn("brand", F.when(c("card_id") % 2 == 0, "VISA").otherwise("Visa Gold")).withColumn("last_four", digits(c("owner_id")))
    amounts = parsed.groupBy("doc_id").agg(F.max("document_total").alias("invoice_amount")).select("*", F.lit(100).cast("decimal(19,2)").alias("previous_balance"), F.lit(40).cast("decimal(19,2)").alias("credits_payments"), c("invoice_amount").alias("purchases_debits"))
    return C.ingest(uploads, rules, feedback, tx, dictionary, keywords, invoices.where("deleted_at is null"), known, amounts=amounts, parts=[part])[part]


@query("up1_ingest", *_UP_VIEWS, sql=_UP + "SELECT tx_id, doc_id, line_no, person_id, description, amount, type, transaction_date, purchase_date, card_key FROM made")
def _(*views):
    return _ingested("entries", *views).select("tx_id", "doc_id", "line_no", "person_id", "description", "amount", "type", "transaction_date", "purchase_date", "card_key")


_UP_CLASSES = ", ".join([_UP.rstrip(), (_RULES.replace("WITH ", "", 1).replace("FROM tx t", "FROM made t").rstrip()), _FEED.replace("AS target FROM tx)", "AS target FROM made)").rstrip(), _MERCH.replace("FROM tx) d", "FROM made) d").rstrip(), _WORDS.replace("FROM tx) d", "FROM made) d").rstrip()])


@query("up1_categories", *_UP_VIEWS, sql=_UP_CLASSES + """ SELECT t.tx_id, CASE WHEN own_category = 'Own' THEN 'Own' ELSE coalesce(rule.c, feedback_category, merch.category, words.category, 'Outros') END AS category,
  CASE WHEN own_category = 'Own' THEN NULL ELSE CAST(CASE WHEN rule.c IS NOT NULL THEN 0.92 WHEN feedback_category IS NOT NULL THEN 0.90 WHEN merch.category IS NOT NULL THEN merch.confidence WHEN words.category IS NOT NULL THEN CASE WHEN score >= 3 THEN 0.85 WHEN score >= 2 THEN 0.75 WHEN score >= 1 THEN 0.65 ELSE 0.55 END ELSE 0.50 END AS DOUBLE) END AS confidence,
  CASE WHEN own_category = 'Own' THEN 'given' WHEN rule.c IS NOT NULL THEN 'rule' WHEN feedback_category IS NOT NULL THEN 'feedback' WHEN merch.category IS NOT NULL THEN 'merchant' WHEN words.category IS NOT NULL THEN 'keywords:' || words.words ELSE 'default' END AS category_by
FROM made t LEFT JOIN rule ON rule.tx_id = t.tx_id LEFT JOIN fb ON fb.person_id = t.person_id AND fb.description = t.description LEFT JOIN merch ON merch.description = t.description LEFT JOIN words ON words.description = t.description""")
def _(*views):
    return _ingested("transactions", *views).select("tx_id", "category", "confidence", "category_by")


@query("up1_installments", *_UP_VIEWS, sql=_UP + "SELECT doc_id, tx_id AS transaction_id, card_key, CAST(number AS INT) AS number, CAST(1 AS INT) AS total, amount, transaction_date AS due_date FROM made")
def _(*views):
    return _ingested("installments", *views)


@query("up1_invoices", *_UP_VIEWS, sql=_UP + """, z AS (SELECT card_key, year, month, arg_max(stated, doc_id) FILTER (doc_id IN (SELECT doc_id FROM alone)) AS stated, max(doc_id) FILTER (doc_id IN (SELECT doc_id FROM alone)) AS since, max(new_due) AS new_due FROM added GROUP BY ALL),
f AS (SELECT card_key, year, month, z.stated, z.new_due, (SELECT coalesce(sum(a.added), 0) FROM added a WHERE a.card_key = z.card_key AND a.year = z.year AND a.month = z.month AND (z.since IS NULL OR a.doc_id > z.since)) AS added FROM z),
o AS (SELECT CAST(card_id AS VARCHAR) AS card_key, year, month, sum(total_amount) AS before, min(due_date) AS old_due FROM invoices WHERE deleted_at IS NULL GROUP BY ALL)
SELECT card_key, year, month, CAST(coalesce(stated, before, 0) + coalesce(added, 0) AS DECIMAL(19,2)) AS total, coalesce(old_due, new_due) AS due_date, CASE WHEN before IS NULL THEN 'insert' WHEN added IS NULL THEN 'keep' ELSE 'update' END AS action FROM f FULL JOIN o USING (card_key, year, month)""")
def _(*views):
    return _ingested("invoices", *views)


@query("up1_new_cards", *_UP_VIEWS, sql=_UP + "SELECT elo_key AS card_key, person_id AS owner_id, split_part(elo_key, '|', 5) AS name, 'elo' AS brand, '9999' AS last_four, CAST(10000 AS DECIMAL(19,2)) AS limit_amount, CAST(5 AS INT) AS closing_day, CAST(15 AS INT) AS due_day FROM e")
def _(*views):
    return _ingested("new_cards", *views)


@query("up1_uploads", *_UP_VIEWS, sql=_UP + """
SELECT m.doc_id, min(purchase_date) AS first_date, max(purchase_date) AS last_date, count(*) AS n, CASE WHEN any_value(alone.doc_id) IS NOT NULL THEN max(document_total) ELSE CAST(sum(CASE WHEN type = 'EXPENSE' THEN amount ELSE -amount END) AS DECIMAL(19,2)) END AS total, CAST(sum(CASE WHEN type = 'EXPENSE' THEN amount ELSE -amount END) AS DECIMAL(19,2)) AS summed
FROM made m LEFT JOIN alone ON alone.doc_id = m.doc_id GROUP BY m.doc_id""")
def _(*views):
    return _ingested("uploads", *views)


@query("up1_capture", *_UP_VIEWS, sql=_UP + f""", t AS (SELECT doc_id, max(document_total) AS invoice_amount FROM parsed GROUP BY 1), s AS (SELECT doc_id, sum(CASE WHEN type = 'EXPENSE' THEN amount ELSE 0 END) AS s FROM made GROUP BY 1), k AS (SELECT t.doc_id, invoice_amount, CAST(coalesce(s, 0) AS DECIMAL(19,2)) AS captured FROM t LEFT JOIN s ON s.doc_id = t.doc_id WHERE invoice_amount > 0)
SELECT doc_id, captured, CAST(invoice_amount - captured AS DECIMAL(19,2)) AS difference, {pct_sql('captured', 'invoice_amount')} AS coverage, CAST(60 AS DECIMAL(19,2)) AS previous_outstanding, abs(invoice_amount - captured) <= 1 AS period_match, FALSE AS recommend FROM k""")
def _(*views):
    return _ingested("capture", *views).select("doc_id", "captured", "difference", "coverage", "previous_outstanding", "period_match", "recommend")


def _from_texts(part: str, parsed, rules, feedback, tx, dictionary, keywords, invoices, cards):
    """Uploads as invoice texts; one in seven was done before, with the same digest."""
    c = F.col
    docs = _invoice_docs(parsed).select("doc_id", "person_id", "text", F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("password"), F.lit(None).cast("date").alias("due_date"), F.lit("Visa 1234").alias("card_name"))
    jobs = docs.where("doc_id % 7 = 0").select("person_id", "sha256", c("doc_id").alias("job_id"), F.lit("DONE").alias("status"), "password", "due_date", F.lit(AS_OF).cast("date").alias("created_at"))
    patterns = parsed.sparkSession.createDataFrame([("worded", "gear"), ("slashed", "widget")], "layout string, pattern string")
    return C.ingest_texts(docs, jobs, _layouts(parsed), patterns, rules, feedback, tx, dictionary, keywords, invoices.where("deleted_at is null"), cards, least_score=50, least_text=0, parts=[part])[part]


_TEXTS = _INV + """, n AS (SELECT doc_id, min(person_id) AS person_id, count(*) AS n, count(d) AS v FROM p GROUP BY 1),
s AS (SELECT *, greatest(0, 30 + CASE WHEN n >= 3 THEN 20 ELSE -25 END + CASE WHEN v * 100 >= n * 80 THEN 30 ELSE 0 END) AS score FROM n WHERE doc_id % 7 <> 0)
"""


@query("up1_from_texts", *_UP_VIEWS, sql=_TEXTS + """SELECT p.doc_id, description, amount, type, due_date AS transaction_date, d AS purchase_date, s.person_id FROM p JOIN s ON s.doc_id = p.doc_id
WHERE score >= 50 AND d IS NOT NULL AND NOT (p.doc_id % 2 = 0 AND contains(description, 'gear')) AND NOT (p.doc_id % 2 = 1 AND contains(description, 'widget'))""")
def _(*views):
    return _from_texts("entries", *views).select("doc_id", "description", "amount", "type", "transaction_date", "purchase_date", "person_id")


@query("up1_refused_texts", *_UP_VIEWS, sql=_TEXTS + "SELECT doc_id, CAST(score AS INT) AS score FROM s WHERE score < 50")
def _(*views):
    return _from_texts("refused", *views)


@query("snk2_score_history", "persons", "tx", "cards", "invoices", sql="SELECT person_id, DATE '2000-05-31' AS calculation_date FROM persons UNION ALL SELECT person_id, DATE '2000-06-30' FROM persons")
def _(persons, tx, cards, invoices):
    """Two dates are written, the second twice, and read back."""
    spark = persons.sparkSession
    at = new_folder(spark, "scores")
    for day in ("2000-05-31", AS_OF, AS_OF):
        write_scores(C.health_scores(persons, tx, cards, invoices, day).withColumn("calculation_date", F.lit(day).cast("date")), at)
    return spark.read.parquet(at).where("score between 0 and 100").select("person_id", "calculation_date")
