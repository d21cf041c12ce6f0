"""Queries: filters, sums, monthly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import summaries as S
from tallyspark.plans.registry import pct_sql, query
from tallyspark.sources.testdata import AS_OF

CAT = "coalesce(nullif(trim(category), ''), 'Outros')"
SUM = lambda cond, x="amount": f"CAST(coalesce(sum(CASE WHEN {cond} THEN {x} END), 0) AS DECIMAL(19,2))"
LIVE = "SELECT * FROM tx WHERE deleted_at IS NULL"
CUBE = f"""WITH cube AS (SELECT person_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, type, purchase_date IS NOT NULL AS card, {CAT} AS category,
  CAST(sum(amount) AS DECIMAL(19,2)) AS total, CAST(sum(abs(amount)) AS DECIMAL(19,2)) AS total_abs, count(*) AS n FROM tx WHERE deleted_at IS NULL GROUP BY ALL)
"""


@query("flt1_filter_transactions", "tx", sql="SELECT tx_id, person_id, amount, transaction_date FROM tx WHERE deleted_at IS NULL AND transaction_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' AND type = 'EXPENSE' AND lower(category) = 'economy'")
def _(tx):
    return S.filter_transactions(tx, "2000-01-01", "2000-06-30", types=["EXPENSE"], category="ECONOMY").select("tx_id", "person_id", "amount", "transaction_date")


@query("flt2_default_range", "tx", sql="SELECT tx_id, transaction_date FROM tx WHERE deleted_at IS NULL AND transaction_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'")
def _(tx):
    return S.filter_transactions(tx, as_of=AS_OF).select("tx_id", "transaction_date")


@query("flt5_statement_rows", "stx", sql="SELECT stx_id, type, amount FROM stx WHERE type <> 'BALANCE' AND NOT (type = 'DEBIT' AND (contains(lower(description), 'fatura') OR contains(lower(description), 'invoice')))")
def _(stx):
    return S.kept_statement_rows(stx).select("stx_id", "type", "amount")


@query("ag1_sum_by_type", "tx", sql=f"SELECT person_id, {SUM('type = ' + chr(39) + 'INCOME' + chr(39))} AS income, {SUM('type = ' + chr(39) + 'EXPENSE' + chr(39))} AS expense FROM tx WHERE deleted_at IS NULL GROUP BY person_id")
def _(tx):
    return S.sum_by_type(S.live(tx))


@query("ag2_category_totals", "tx", sql=f"SELECT person_id, {CAT} AS category, CAST(sum(amount) AS DECIMAL(19,2)) AS total FROM tx WHERE deleted_at IS NULL AND type = 'EXPENSE' GROUP BY ALL")
def _(tx):
    return S.category_totals(S.live(tx))


@query("ag3_month_type_totals", "tx", sql="SELECT person_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, type, CAST(sum(amount) AS DECIMAL(19,2)) AS total, count(*) AS n FROM tx WHERE deleted_at IS NULL GROUP BY ALL")
def _(tx):
    return S.month_type_totals(S.live(tx))


@query("ag_base_cube", "tx", sql=CUBE + "SELECT * FROM cube")
def _(tx):
    return S.base_cube(tx)


@query("ag4_monthly_summary", "tx", sql=CUBE + f""", s AS (SELECT person_id, month, {SUM("type = 'INCOME'", 'total')} AS income, {SUM("type = 'EXPENSE'", 'total')} AS expenses FROM cube GROUP BY ALL)
SELECT *, CAST(income - expenses AS DECIMAL(19,2)) AS balance, CAST({pct_sql('income - expenses', 'income', 0)} AS BIGINT) AS savings_rate FROM s""")
def _(tx):
    return S.monthly_summary(S.base_cube(tx))


def _of(kind: str, extra: str = "") -> str:
    return SUM(f"type = '{kind}'{extra}", "total")


@query("ag5_dashboard_totals", "tx", sql=CUBE + f""", s AS (SELECT person_id, {_of('INCOME', ' AND month(month) = 6')} AS month_income, {_of('EXPENSE', ' AND month(month) = 6')} AS month_expenses, {_of('INCOME')} AS year_income, {_of('EXPENSE')} AS year_expenses
  FROM cube WHERE year(month) = 2000 AND month(month) <= 6 GROUP BY person_id)
SELECT *, CAST(month_income - month_expenses AS DECIMAL(19,2)) AS month_balance, CAST(year_income - year_expenses AS DECIMAL(19,2)) AS year_balance FROM s""")
def _(tx):
    return S.dashboard_totals(S.base_cube(tx), 2000, 6)


STATEMENT_CATEGORY = "CASE WHEN type = 'CREDIT' AND contains(description, 'URGENT') THEN 'Renda' WHEN contains(description, 'HIGH') OR contains(description, 'URGENT') THEN 'Moradia' WHEN type = 'DEBIT' AND contains(description, 'MEDIUM') THEN 'Utilidades' ELSE 'Outros' END"
CHARTS = CUBE + f""", sides AS (SELECT person_id, month, type, card, category, total, total_abs, FALSE AS statement FROM cube
  UNION ALL SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE), CASE WHEN type = 'CREDIT' THEN 'INCOME' ELSE 'EXPENSE' END, FALSE, {STATEMENT_CATEGORY}, abs(amount), abs(amount), TRUE FROM stx WHERE type IN ('CREDIT', 'DEBIT') AND NOT (type = 'DEBIT' AND (contains(lower(description), 'fatura') OR contains(lower(description), 'invoice'))))
"""


def _breakdown(month: str) -> str:
    return CHARTS + f""", s AS (SELECT person_id, {month} AS month, category, CAST(sum(total_abs) AS DECIMAL(19,2)) AS total FROM sides WHERE type = 'EXPENSE' GROUP BY ALL),
w AS (SELECT *, sum(total) OVER (PARTITION BY person_id, month) AS whole FROM s)
SELECT person_id, month, category, total, {pct_sql('total', 'whole')} AS percent, row_number() OVER (PARTITION BY person_id, month ORDER BY total DESC, category) AS rank FROM w WHERE whole <> 0"""


@query("ag6_wn1_category_breakdown", "tx", "stx", sql=_breakdown("month"))
def _(tx, stx):
    return S.category_breakdown(S.charts_cube(tx, stx, statement_rules(tx)))


@query("ag6_year_breakdown", "tx", "stx", sql=_breakdown("CAST(date_trunc('year', month) AS DATE)"))
def _(tx, stx):
    return S.category_breakdown(S.charts_cube(tx, stx, statement_rules(tx)), "year")


def _evolution(first: str, last: str) -> str:
    return CHARTS + f""", grid AS (SELECT DISTINCT person_id, CAST(m AS DATE) AS month FROM sides, (SELECT unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH)) AS m)),
s AS (SELECT person_id, month, {_of('INCOME')} AS i, {SUM("type = 'EXPENSE'", 'total_abs')} AS e, {_of('INCOME', ' AND statement')} AS a, {SUM("type = 'EXPENSE' AND NOT card", 'total_abs')} AS b, {SUM("type = 'EXPENSE' AND card", 'total_abs')} AS c FROM sides GROUP BY ALL)
SELECT person_id, month, CAST(coalesce(i, 0) AS DECIMAL(19,2)) AS income, CAST(coalesce(e, 0) AS DECIMAL(19,2)) AS expenses, CAST(coalesce(a, 0) AS DECIMAL(19,2)) AS income_checking, CAST(coalesce(b, 0) AS DECIMAL(19,2)) AS expenses_checking, CAST(coalesce(c, 0) AS DECIMAL(19,2)) AS expenses_card FROM grid LEFT JOIN s USING (person_id, month)"""


@query("ag7_ag8_monthly_evolution", "tx", "stx", sql=_evolution("2000-01-01", "2000-12-01"))
def _(tx, stx):
    return S.monthly_evolution(S.charts_cube(tx, stx, statement_rules(tx)), "2000-01-01", 12)


@query("ag7_six_months", "tx", "stx", sql=_evolution("1999-11-01", "2000-04-01"))
def _(tx, stx):
    return S.monthly_evolution(S.charts_cube(tx, stx, statement_rules(tx)), "1999-11-01", 6)


@query("ag10_wn6_statement_summary", "stx", "statements", sql="""WITH r AS (SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month, CAST(coalesce(sum(CASE WHEN type = 'CREDIT' THEN abs(amount) END), 0) AS DECIMAL(19,2)) AS credits, CAST(coalesce(sum(CASE WHEN type <> 'CREDIT' THEN abs(amount) END), 0) AS DECIMAL(19,2)) AS expenses, count(*) AS c
  FROM stx WHERE type <> 'BALANCE' GROUP BY ALL),
e AS (SELECT user_id, CAST(date_trunc('month', statement_date) AS DATE) AS month, arg_min(opening_balance, statement_date) AS opening, arg_max(closing_balance, statement_date) AS closing FROM statements GROUP BY ALL)
SELECT r.user_id, r.month, credits, expenses, CAST(credits - expenses AS DECIMAL(19,2)) AS balance, c + CASE WHEN opening IS NOT NULL THEN 1 ELSE 0 END AS n, opening, closing FROM r LEFT JOIN e ON r.user_id = e.user_id AND r.month = e.month""")
def _(stx, statements):
    return S.statement_summary(stx, statements)


def statement_rules(df):
    return df.sparkSession.createDataFrame([(0, "CREDIT", ["urgent"], "Renda"), (1, None, ["high", "urgent"], "Moradia"), (2, "DEBIT", ["medium"], "Utilidades")], "ordinal int, type string, patterns array<string>, category string")


@query("so1_tk6_cashflow", "tx", "stx", sql="""SELECT tx_id, person_id, description, amount, type, category, transaction_date, purchase_date, status, 'transaction' AS origin FROM tx WHERE deleted_at IS NULL
UNION ALL SELECT 's' || stx_id, user_id, description, amount, CASE WHEN type = 'CREDIT' THEN 'INCOME' ELSE 'EXPENSE' END, CASE WHEN type = 'CREDIT' AND contains(description, 'URGENT') THEN 'Renda' WHEN contains(description, 'HIGH') OR contains(description, 'URGENT') THEN 'Moradia' WHEN type = 'DEBIT' AND contains(description, 'MEDIUM') THEN 'Utilidades' ELSE 'Outros' END, transaction_date, transaction_date, 'PAID', 'statement' FROM stx WHERE type <> 'BALANCE' AND trim(description) <> ''""")
def _(tx, stx):
    return S.cashflow(tx, stx, statement_rules(tx)).orderBy(F.asc_nulls_last("transaction_date"), "tx_id")


@query("tk1_latest", "tx_dense", sql="SELECT person_id, tx_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY person_id ORDER BY transaction_date DESC, tx_id) AS INT) AS rank FROM tx_dense WHERE deleted_at IS NULL) WHERE rank <= 200")
def _(tx):
    return S.latest(tx).select("person_id", "tx_id", "rank")


@query("tk2_page", "tx_dense", sql="""SELECT person_id, tx_id, rank, (n + 19) // 20 AS pages FROM (SELECT *, CAST(row_number() OVER (PARTITION BY person_id ORDER BY transaction_date DESC, tx_id) AS INT) AS rank, count(*) OVER (PARTITION BY person_id) AS n FROM tx_dense WHERE deleted_at IS NULL) WHERE rank BETWEEN 21 AND 40""")
def _(tx):
    return S.page(tx, 1, 20).select("person_id", "tx_id", "rank", "pages")


_HALF = "make_date(CAST(year(transaction_date) AS INT), CAST(((month(transaction_date) - 1) // 6) * 6 + 1 AS INT), 1)"


@query("ag11_sf12_period_summary", "tx", sql=f"""WITH s AS (SELECT person_id, {_HALF} AS period_start, CAST(coalesce(sum(CASE WHEN type = 'INCOME' THEN abs(amount) END), 0) AS DECIMAL(19,2)) AS income, CAST(coalesce(sum(CASE WHEN type = 'EXPENSE' THEN abs(amount) END), 0) AS DECIMAL(19,2)) AS expenses FROM tx WHERE deleted_at IS NULL GROUP BY ALL)
SELECT a.person_id, a.period_start, CAST(a.period_start + INTERVAL 6 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, a.income, a.expenses, CAST(coalesce(b.income, 0) AS DECIMAL(19,2)) AS previous_income, CAST(coalesce(b.expenses, 0) AS DECIMAL(19,2)) AS previous_expenses,
  CAST(a.income - coalesce(b.income, 0) AS DECIMAL(19,2)) AS income_change, CAST(a.expenses - coalesce(b.expenses, 0) AS DECIMAL(19,2)) AS expense_change FROM s a LEFT JOIN s b ON a.person_id = b.person_id AND a.period_start = CAST(b.period_start + INTERVAL 6 MONTH AS DATE)""")
def _(tx):
    return S.period_summary(tx, "SEMIANNUAL")


@query("ag12_period_breakdown", "tx", sql=f"""WITH s AS (SELECT person_id, CAST(date_trunc('year', transaction_date) AS DATE) AS period_start, type, {CAT} AS category, CAST(sum(abs(amount)) AS DECIMAL(19,2)) AS total FROM tx WHERE deleted_at IS NULL GROUP BY ALL),
w AS (SELECT *, sum(total) OVER (PARTITION BY person_id, period_start, type) AS whole FROM s) SELECT person_id, period_start, type, category, total, {pct_sql('total', 'whole')} AS percent FROM w""")
def _(tx):
    return S.period_breakdown(tx, "ANNUAL")
