"""Domain tables derived from the TPC-H-like test tables.

Each is one SELECT in a dialect that Spark and DuckDB share, with base tables in braces, so that
queries and their oracles start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2000-06-30"

_TX = """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS tx_id,
  {person} AS person_id, p_name AS description, CAST(l_extendedprice AS DECIMAL(19,2)) AS amount,
  CASE WHEN l_returnflag = 'R' THEN 'INCOME' ELSE 'EXPENSE' END AS type,
  CASE WHEN l_linestatus = 'F' THEN 'PERSONAL' ELSE 'BUSINESS' END AS scope,
  CASE WHEN p_size = 1 THEN '' WHEN p_size = 2 THEN NULL ELSE p_type END AS category,
  CAST(l_shipdate AS DATE) AS transaction_date,
  CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) - CAST(l_quantity AS INT) END AS purchase_date,
  CASE o_orderstatus WHEN 'F' THEN 'PAID' WHEN 'O' THEN 'OVERDUE' ELSE 'PENDING' END AS status,
  CASE WHEN l_discount >= 0.10 THEN CAST(l_shipdate AS DATE) END AS deleted_at,
  l_orderkey AS invoice_key, l_linenumber AS line_no, CAST(o_orderdate AS DATE) AS due_date
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey"""

VIEWS = {
    "tx": _TX.replace("{person}", "o_custkey"),
    "tx_dense": _TX.replace("{person}", "o_custkey % 60"),
    "stx": """SELECT o_orderkey AS stx_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS transaction_date, o_orderpriority AS description,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CREDIT' WHEN '5-LOW' THEN 'BALANCE' ELSE 'DEBIT' END AS type,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(19,2)) AS amount FROM {orders}""",
    "statements": """SELECT o_custkey AS user_id, last_day(CAST(o_orderdate AS DATE)) AS statement_date, CAST(min(o_totalprice) AS DECIMAL(19,2)) AS opening_balance,
  CAST(max(o_totalprice) AS DECIMAL(19,2)) AS closing_balance FROM {orders} GROUP BY o_custkey, last_day(CAST(o_orderdate AS DATE))""",
    "cards": """SELECT 2 * c_custkey + k AS card_id, c_custkey AS owner_id, concat(c_mktsegment, ' card') AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS cardholder_name,
  c_mktsegment AS brand, CAST(c_custkey % 10000 AS INT) AS last_four, CAST(10000 + 10 * abs(c_acctbal) AS DECIMAL(19,2)) AS limit_amount, CAST(c_custkey % 28 + 1 AS INT) AS due_day FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) two""",
    "invoices": """SELECT o_orderkey AS invoice_id, 2 * o_custkey + o_orderkey % 2 AS card_id, CAST(month(CAST(o_orderdate AS DATE)) AS INT) AS month, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year,
  CAST(o_orderdate AS DATE) + 10 AS due_date, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(19,2)) AS total_amount, CAST(floor(o_totalprice * (o_orderkey % 4) * 25) / 100 AS DECIMAL(19,2)) AS paid_amount,
  CASE o_orderstatus WHEN 'P' THEN 'OPEN' WHEN 'F' THEN 'PAID' ELSE 'CLOSED' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 10 + CAST(o_orderkey % 7 - 3 AS INT) END AS paid_date, CASE WHEN o_orderkey % 97 = 0 THEN CAST(o_orderdate AS DATE) END AS deleted_at FROM {orders}""",
    "installments": """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS transaction_id, l_orderkey AS invoice_id,
  l_linenumber AS number, CAST(l_extendedprice AS DECIMAL(19,2)) AS amount, CAST(l_shipdate AS DATE) AS due_date FROM {lineitem}""",
    "persons": "SELECT c_custkey AS person_id, c_name AS name FROM {customer}",
    "users": """SELECT c_custkey AS user_id, c_name AS name, concat('user', CAST(c_custkey AS STRING), '@', lower(c_mktsegment), '.example') AS email, CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'FREE' WHEN 'BUILDING' THEN 'PREMIUM' ELSE 'ESSENTIAL' END AS plan, CASE WHEN c_custkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, DATE '1999-01-01' + CAST(c_custkey % 400 AS INT) AS created_at FROM {customer}""",
    "subscriptions": """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 = 0 THEN 'CANCELED' ELSE 'ACTIVE' END AS status, DATE '2000-06-30' - CAST(c_custkey % 90 + 5 AS INT) AS start_date,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE DATE '2000-06-30' + CAST(c_custkey % 61 - 30 AS INT) END AS end_date FROM {customer} WHERE c_custkey % 6 <> 0""",
    "payments": """SELECT o_orderkey AS payment_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' ELSE 'PENDING' END AS status, CAST(o_totalprice AS DECIMAL(19,2)) AS amount, CAST(o_orderdate AS DATE) AS paid_at FROM {orders}""",
    "goals": """SELECT c_custkey AS goal_id, c_custkey AS owner_id, CASE WHEN c_custkey % 5 = 0 THEN concat('Budget: ', t) ELSE 'Emergency fund' END AS title, CAST(CASE WHEN c_custkey % 5 = 0 THEN abs(c_acctbal) * 5 ELSE c_acctbal END AS DECIMAL(19,2)) AS target_amount,
  CAST(abs(c_acctbal) / 3 AS DECIMAL(19,2)) AS current_amount, CASE c_custkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'COMPLETED' ELSE 'CANCELED' END AS status, DATE '1999-01-01' + CAST(c_custkey % 300 AS INT) AS created_at
  FROM {customer} JOIN (SELECT p_partkey AS pk, p_type AS t FROM {part}) p ON pk = c_custkey % 100 + 1""",
    "budgets": """SELECT c_custkey AS owner_id, CAST(abs(c_acctbal) + 1000 * (c_custkey % 5) AS DECIMAL(19,2)) AS income, CAST(400 + c_custkey % 700 AS DECIMAL(19,2)) AS essential_fixed_cost, CAST(c_custkey % 300 AS DECIMAL(19,2)) AS necessary_fixed_cost,
  CAST(100 + c_custkey % 450 AS DECIMAL(19,2)) AS variable_fixed_cost, CAST(c_custkey % 900 AS DECIMAL(19,2)) AS investment, CAST(c_custkey % 110 AS DECIMAL(19,2)) AS planned_purchase, CAST(c_custkey % 75 AS DECIMAL(19,2)) AS debt, CAST(c_custkey % 60 AS DECIMAL(19,2)) AS protection FROM {customer}""",
    "investments": """SELECT p_partkey AS investment_id, p_partkey % 200 AS owner_id, p_type AS type, CAST(p_retailprice AS DECIMAL(19,2)) AS initial_value, CAST(floor(p_retailprice * (80 + p_size)) / 100 AS DECIMAL(19,2)) AS current_value, p_partkey % 12 = 0 AS excluded, p_name AS name FROM {part}""",
    "assets": """SELECT s_suppkey AS asset_id, s_suppkey % 200 AS owner_id, CASE s_suppkey % 3 WHEN 0 THEN 'REAL_ESTATE' WHEN 1 THEN 'VEHICLE' ELSE 'INVESTMENT' END AS type, CAST(abs(s_acctbal) * 10 AS DECIMAL(19,2)) AS current_value,
  s_suppkey % 3 = 2 AS synced, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey * 7 END AS investment_id FROM {supplier}""",
    "rules": """SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'widget' WHEN 1 THEN 'bolt' WHEN 2 THEN 'ring' ELSE 'gear' END AS pattern, concat('rule ', CAST(c_custkey % 4 AS STRING)) AS category, CAST(c_custkey % 3 AS INT) AS priority, DATE '1999-01-01' + CAST(c_custkey % 50 AS INT) AS created_at FROM {customer} WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'steel' WHEN 1 THEN 'small' ELSE 'cog' END, 'rule second', CAST(c_custkey % 5 AS INT), DATE '1999-06-01' FROM {customer} WHERE c_custkey % 3 = 0""",
    "feedback": """SELECT o_custkey AS user_id, concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS transaction_id, p_type AS chosen_category, CAST(o_orderdate AS DATE) AS created_at
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE (l_orderkey + l_partkey + l_suppkey + l_linenumber) % 10 = 0""",
    "audit": """SELECT event_id, ts, user_id, concat('10.0.0.', CAST(user_id % 50 AS STRING)) AS ip, event_type AS action, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, props AS details, concat('user', CAST(user_id AS STRING), '@mail.example') AS user_email FROM {events}""",
    "recurring": _TX.replace("{person}", "o_custkey").replace("l_orderkey AS invoice_key", "l_orderkey AS invoice_key") + """
  UNION ALL SELECT concat('r', CAST(c_custkey AS STRING), '-', CAST(k AS STRING)), c_custkey, concat(c_mktsegment, ' plan ', CAST(k AS STRING)), CAST(20 + c_custkey % 50 + 0.1 * k AS DECIMAL(19,2)), 'EXPENSE', 'PERSONAL', 'Services',
  CAST(concat('2000-0', CAST(k AS STRING), '-01') AS DATE) + CAST(4 + c_custkey % 15 AS INT), NULL, 'PAID', NULL, c_custkey, CAST(1 AS INT), NULL FROM {customer} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) m WHERE NOT (c_custkey % 3 = 0 AND k = 5)""",
    # lines of statement text: one document per customer-month, a balance at every third line
    "text_lines": """SELECT concat(CAST(o_custkey AS STRING), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7)) AS doc_id, o_orderkey AS line_no,
  CONCAT(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4), ' ', o_orderpriority, ' ',
  replace(CAST(CAST(o_totalprice AS DECIMAL(19,2)) AS STRING), '.', ','), CASE WHEN o_orderpriority = '1-URGENT' THEN 'C' ELSE 'D' END, CASE WHEN o_orderkey % 3 = 0 THEN concat(' ', replace(CAST(CAST(o_totalprice * 2 AS DECIMAL(19,2)) AS STRING), '.', ',')) ELSE '' END) AS line FROM {orders}""",
    # parsed rows of uploads: an upload is an order
    "parsed": """SELECT l_orderkey AS doc_id, l_linenumber AS line_no, p_name AS description, CAST(CASE WHEN l_quantity > 49 THEN 0 ELSE l_extendedprice END AS DECIMAL(19,2)) AS amount, CASE WHEN l_returnflag = 'R' THEN 'INCOME' ELSE 'EXPENSE' END AS type,
  CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) END AS installment_number, p_brand AS card_name, CAST(o_totalprice AS DECIMAL(19,2)) AS document_total,
  CAST(o_orderdate AS DATE) AS due_date, o_custkey AS person_id, l_suppkey AS layout FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "docs": "SELECT doc_id, text, lang, source FROM {documents}",
    # merchants and keywords: small dictionaries of our own
    "dictionary": """SELECT 0 AS ordinal, 'widget' AS pattern, 'Parts' AS category, 0.80 AS confidence UNION ALL SELECT 1, 'small|ring', 'Jewels', 0.85 UNION ALL SELECT 2, 'steel', 'Metal', 0.80 UNION ALL SELECT 3, 'cog', 'Gears', 0.70 UNION ALL SELECT 4, 'large|bolt', 'Bolts', 0.85""",
    "keywords": """SELECT 'Parts' AS category, 'gear' AS keyword, 2.0 AS weight UNION ALL SELECT 'Parts', 'plate', 1.0 UNION ALL SELECT 'Home', 'red', 1.5 UNION ALL SELECT 'Home', 'blue', 1.5 UNION ALL SELECT 'Metal', 'brass', 3.0 UNION ALL SELECT 'Metal', 'gear', 0.5""",
}
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def ctes(names: list[str]) -> str:
    """The same views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'{(' + '|'.join(TABLES) + ')}', r'\1', VIEWS[n])})" for n in names) + "\n"
