"""Queries: detection over months and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import description_key
from tallyspark.operators import detection as D
from tallyspark.operators.summaries import base_cube, live
from tallyspark.plans.registry import pct_sql, query
from tallyspark.plans.summaries import CUBE
from tallyspark.sources.testdata import AS_OF

DENSE = CUBE.replace("FROM tx ", "FROM tx_dense ")
_M = "CAST(sum(total_abs) AS DECIMAL(19,2)) AS total"


@query("wn2_top_category", "tx", sql=CUBE + f""", s AS (SELECT person_id, month, category, {_M} FROM cube WHERE type = 'EXPENSE' GROUP BY ALL), w AS (SELECT *, sum(total) OVER (PARTITION BY person_id, month) AS whole, row_number() OVER (PARTITION BY person_id, month ORDER BY total DESC, category) AS r FROM s)
SELECT person_id, month, category, total, {pct_sql('total', 'whole', 1)} AS percent FROM w WHERE r = 1 AND whole > 0""")
def _(tx):
    return D.top_category(base_cube(tx))


@query("wn3_monthly_growth", "tx_dense", sql=DENSE + f""", s AS (SELECT person_id, month, {_M}, year(month) * 12 + month(month) AS idx FROM cube WHERE type = 'EXPENSE' GROUP BY ALL),
j AS (SELECT a.person_id, a.month, a.total, b.total AS previous, CAST((a.total - b.total) * 100 AS HUGEINT) AS d, CAST(b.total * 100 AS HUGEINT) AS p FROM s a JOIN s b ON a.person_id = b.person_id AND a.idx = b.idx + 1 WHERE b.total > 0)
SELECT person_id, month, total, previous, CAST(sign(d) * ((2 * abs(d) * 100 + p) // (2 * p)) AS DECIMAL(19,2)) AS growth FROM j""")
def _(tx):
    return D.monthly_growth(base_cube(tx))


@query("wn4_anomalies", "tx_dense", sql=DENSE + f""", s AS (SELECT person_id, category, month, {_M}, year(month) * 12 + month(month) AS idx FROM cube WHERE type = 'EXPENSE' GROUP BY ALL),
w AS (SELECT *, CAST(total AS DOUBLE) AS d, avg(CAST(total AS DOUBLE)) OVER b AS mean, coalesce(stddev_samp(CAST(total AS DOUBLE)) OVER b, 0) AS sd, count(*) OVER b AS n FROM s WHERE total > 0 WINDOW b AS (PARTITION BY person_id, category ORDER BY idx RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, row_number() OVER (PARTITION BY person_id, month ORDER BY round(d - mean, 4) DESC, category) AS rank FROM w WHERE n >= 2 AND d > CASE WHEN sd = 0 THEN 1.75 * mean ELSE mean + 2 * sd END AND d > 1.35 * mean AND d - mean > 50)
SELECT person_id, month, category, total, round(mean, 4) AS mean, CASE WHEN d > 2 * mean THEN 'alert' ELSE 'warning' END AS severity, rank FROM h WHERE rank <= 3""")
def _(tx):
    return D.anomalies(base_cube(tx))


_CAND = "type = 'EXPENSE' AND abs(amount) >= 5 AND trim(description) <> '' AND NOT regexp_matches(lower(description), 'pix|transfer|ted|doc|saque|withdrawal')"
_KEY = "trim(regexp_replace(regexp_replace(lower(trim(description)), '[0-9]', '', 'g'), '[^a-z]+', ' ', 'g'))"


_RECURRING = f"""WITH RECURSIVE a AS (SELECT person_id, {_KEY} AS key, CAST(abs(amount) * 100 AS BIGINT) AS cents, transaction_date, tx_id, trim(description) AS name, year(transaction_date) * 12 + month(transaction_date) AS idx, day(transaction_date) AS day
  FROM recurring WHERE deleted_at IS NULL AND {_CAND} AND transaction_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30' AND {_KEY} <> ''),
g AS (SELECT person_id, key, min(cents) AS low FROM a GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT idx) = 3),
b AS (SELECT a.* FROM a JOIN g ON g.person_id = a.person_id AND g.key = a.key),
s AS (SELECT person_id, key, low AS start FROM g
  UNION ALL SELECT s.person_id, s.key, min(b.cents) FROM s JOIN b ON b.person_id = s.person_id AND b.key = s.key WHERE b.cents - s.start > greatest(200, (s.start * 5 + 50) // 100) GROUP BY s.person_id, s.key),
c AS (SELECT b.person_id, b.key, b.tx_id, max(s.start) AS cluster FROM b JOIN s ON b.person_id = s.person_id AND b.key = s.key AND s.start <= b.cents GROUP BY ALL),
r AS (SELECT b.*, c.cluster FROM b JOIN c ON b.person_id = c.person_id AND b.key = c.key AND b.tx_id = c.tx_id),
d AS (SELECT person_id, key, cluster, max(day) - min(day) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY person_id, key, cluster, idx ORDER BY cents, transaction_date, tx_id) AS k FROM r) WHERE k = 1 GROUP BY ALL),
m AS (SELECT person_id, key, cluster, count(*) AS n, count(DISTINCT idx) AS months, CAST(sum(cents) AS HUGEINT) AS s1, sum(CAST(cents AS HUGEINT) * cents) AS s2 FROM r GROUP BY ALL),
l AS (SELECT person_id, key, cluster, name FROM (SELECT person_id, key, cluster, name, count(*) AS times, min(cents * 100000 + (transaction_date - DATE '2000-01-01')) AS first FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY person_id, key, cluster ORDER BY times DESC, first, name) = 1),
found AS (SELECT m.person_id, m.key, coalesce(l.name, 'Assinatura') AS label, m.n, CAST(((2 * s1 + m.n) // (2 * m.n)) / 100.0 AS DECIMAL(19,2)) AS monthly_cost
  FROM m JOIN d ON d.person_id = m.person_id AND d.key = m.key AND d.cluster = m.cluster LEFT JOIN l ON l.person_id = m.person_id AND l.key = m.key AND l.cluster = m.cluster
  WHERE m.n >= 3 AND months = 3 AND spread <= 10 AND sqrt(CAST(m.n * s2 - s1 * s1 AS DOUBLE) / (m.n * (m.n - 1))) / 100 <= greatest(5.0, 0.08 * (CAST(s1 AS DOUBLE) / m.n / 100)))
"""


@query("wn5_wn12_recurring", "recurring", sql=_RECURRING + "SELECT * FROM found")
def _(tx):
    return D.recurring(live(tx), AS_OF)


@query("flt7_subscription_candidates", "recurring", sql=f"SELECT tx_id FROM recurring WHERE {_CAND} AND regexp_matches(lower(description), 'plan|assinatura|subscription|mensal|premium')")
def _(tx):
    return tx.where(D.is_subscription_candidate(tx, 5, positive=True)).select("tx_id")


def _words(df, *rows):
    return df.sparkSession.createDataFrame(rows, "kind string, pattern string")


@query("flt7_subscription_words", "recurring", sql="SELECT tx_id FROM recurring WHERE type = 'EXPENSE' AND abs(amount) >= 8 AND NOT regexp_matches(lower(description), 'bolt|lar|5') AND regexp_matches(lower(description), 'pla|ing|gear')")
def _(tx):
    words = _words(tx, *[("transfer", w) for w in ("bolt", "lar", "5")], *[("subscription", w) for w in ("pla", "ing", "gear")])
    return D.subscription_candidates(tx, words, 8, positive=True).select("tx_id")


@query("so5_month_coverage", "recurring", sql=f"""SELECT person_id, {_KEY} AS key, count(*) AS n FROM recurring WHERE deleted_at IS NULL AND {_CAND} AND transaction_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30' AND {_KEY} <> '' GROUP BY ALL HAVING count(DISTINCT month(transaction_date)) = 3""")
def _(tx):
    rows = live(tx).where(D.is_subscription_candidate(tx) & F.col("transaction_date").between("2000-04-01", "2000-06-30"))
    keyed = rows.withColumn("key", description_key(F.col("description"))).where("key <> ''")
    return keyed.groupBy("person_id", "key").agg(F.count("*").alias("n"), F.count_distinct(F.month("transaction_date")).alias("m")).where("m = 3").drop("m")


@query("tk3_default_examples", "tx", sql="""WITH s AS (SELECT person_id, description, CAST(sum(abs(amount)) AS DECIMAL(19,2)) AS spent FROM tx WHERE type = 'EXPENSE' AND coalesce(nullif(trim(category), ''), 'Outros') = 'Outros' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY spent DESC, description) AS r FROM s)
SELECT person_id, count(*) AS n, CAST(sum(spent) AS DECIMAL(19,2)) AS total, string_agg(description, ', ' ORDER BY r) FILTER (r <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS items FROM r GROUP BY person_id""")
def _(tx):
    return D.default_examples(tx)


_TRIP = r"""WITH c AS (SELECT person_id, coalesce(purchase_date, transaction_date) AS day FROM tx_dense WHERE type = 'EXPENSE' AND regexp_matches(lower(description), '\bring\b')),
w AS (SELECT person_id, day, count(*) OVER a AS n, max(day) OVER a AS last FROM c WINDOW a AS (PARTITION BY person_id ORDER BY day RANGE BETWEEN INTERVAL 0 DAYS PRECEDING AND INTERVAL 30 DAYS FOLLOWING)),
t AS (SELECT DISTINCT person_id, day AS trip_start, last AS trip_end, n AS candidates FROM w WHERE n >= 4 QUALIFY rank() OVER (PARTITION BY person_id ORDER BY n DESC, day) = 1)
"""


@query("wn8_trips", "tx_dense", sql=_TRIP + "SELECT person_id, trip_start, CAST(trip_end AS DATE) AS trip_end, candidates FROM t")
def _(tx):
    return D.trips(tx, ["ring"])


_BATCH_TRIP = _TRIP.replace("c AS (SELECT person_id,", "c AS (SELECT person_id, invoice_key % 3 AS batch,").replace("w AS (SELECT person_id,", "w AS (SELECT person_id, batch,").replace("PARTITION BY person_id", "PARTITION BY person_id, batch").replace("SELECT DISTINCT person_id,", "SELECT DISTINCT person_id, batch,")


@query("wn8_batch_trips", "tx_dense", sql=_BATCH_TRIP + "SELECT person_id, batch, trip_start, CAST(trip_end AS DATE) AS trip_end, candidates FROM t")
def _(tx):
    return D.trips(tx.withColumn("batch", F.col("invoice_key") % 3), ["ring"], by=("person_id", "batch"))


@query("jn13_batch_trip_expenses", "tx_dense", sql=_BATCH_TRIP + ", e AS (SELECT x.person_id, x.invoice_key % 3 AS batch, tx_id, trip_start, CAST(trip_end AS DATE) AS trip_end, count(*) OVER (PARTITION BY x.person_id, x.invoice_key % 3) AS n FROM tx_dense x JOIN t ON t.person_id = x.person_id AND t.batch = x.invoice_key % 3 AND coalesce(purchase_date, transaction_date) BETWEEN trip_start AND trip_end WHERE type = 'EXPENSE') SELECT * FROM e WHERE n >= 4")
def _(tx):
    by, batched = ("person_id", "batch"), tx.withColumn("batch", F.col("invoice_key") % 3)
    return D.trip_expenses(batched, D.trips(batched, ["ring"], by=by), by=by)


@query("jn13_trip_expenses", "tx_dense", sql=_TRIP + ", e AS (SELECT x.person_id, tx_id, trip_start, CAST(trip_end AS DATE) AS trip_end, count(*) OVER (PARTITION BY x.person_id) AS n FROM tx_dense x JOIN t ON t.person_id = x.person_id AND coalesce(purchase_date, transaction_date) BETWEEN trip_start AND trip_end WHERE type = 'EXPENSE') SELECT * FROM e WHERE n >= 4")
def _(tx):
    return D.trip_expenses(tx, D.trips(tx, ["ring"]))


_VOLATILE = DENSE + f""", s AS (SELECT person_id, month, category, {_M} FROM cube WHERE type = 'EXPENSE' GROUP BY ALL), p AS (SELECT person_id, count(DISTINCT month) AS months FROM cube GROUP BY 1),
g AS (SELECT q.person_id, q.category, q.month, coalesce(s.total, 0) AS total, months FROM (SELECT * FROM (SELECT DISTINCT person_id, category FROM s) JOIN (SELECT DISTINCT person_id, month FROM cube) USING (person_id)) q JOIN p ON p.person_id = q.person_id LEFT JOIN s ON s.person_id = q.person_id AND s.category = q.category AND s.month = q.month),
v AS (SELECT person_id, category, sum(total) AS t, any_value(months) AS months, avg(CAST(total AS DOUBLE)) AS mean, round(stddev_samp(CAST(total AS DOUBLE)) / avg(CAST(total AS DOUBLE)), 4) AS cv FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY cv DESC, category) AS rank FROM v WHERE mean >= 120 AND cv >= 0.35),
volatile AS (SELECT person_id, category, round(mean, 4) AS mean, cv, CAST(((2 * CAST(t * 100 AS HUGEINT) * 11 + months * 10) // (2 * months * 10)) / 100.0 AS DECIMAL(19,2)) AS budget, rank FROM r WHERE rank <= 2)
"""


@query("wn10_volatility", "tx_dense", sql=_VOLATILE + "SELECT * FROM volatile")
def _(tx):
    return D.volatility(base_cube(tx))


_CRIT = "CASE WHEN abs(amount) >= 50000 THEN 'HIGH_VALUE' WHEN lower(category) = 'economy' THEN 'RISKY_CATEGORY' WHEN contains(lower(description), 'gear') THEN 'SUSPICIOUS_DESCRIPTION' END"
_FLAG = dict(threshold=50000, risky=["economy"], keywords=["gear"])


@query("flt10_flag_critical", "tx", sql=f"SELECT tx_id, {_CRIT} AS critical_reason, {_CRIT} IS NOT NULL AS is_critical FROM tx")
def _(tx):
    return D.flag_critical(tx, **_FLAG).select("tx_id", "critical_reason", "is_critical")


@query("flt11_unreviewed_critical", "tx", sql=f"SELECT tx_id, transaction_date FROM tx WHERE {_CRIT} = 'RISKY_CATEGORY' AND deleted_at IS NULL")
def _(tx):
    return D.unreviewed_critical(D.flag_critical(tx, **_FLAG), "RISKY_CATEGORY").select("tx_id", "transaction_date")


@query("ag15_critical_stats", "tx", sql=f"""WITH c AS (SELECT person_id, {_CRIT} AS reason, count(*) AS n FROM tx WHERE {_CRIT} IS NOT NULL AND deleted_at IS NULL GROUP BY ALL)
SELECT person_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS unreviewed, string_agg(reason || '=' || n, ';' ORDER BY reason) AS by_reason FROM c GROUP BY person_id""")
def _(tx):
    return D.critical_stats(D.flag_critical(tx, **_FLAG))


@query("jn7_budget_exceeded", "tx_dense", "goals", sql=DENSE + """, s AS (SELECT person_id, lower(category) AS key, sum(total_abs) AS spent FROM cube WHERE type = 'EXPENSE' AND month = DATE '2000-06-01' GROUP BY ALL),
g AS (SELECT goal_id, owner_id, lower(trim(regexp_extract(title, '(?i)^budget:\\s*(.+)$', 1))) AS key, target_amount FROM goals WHERE status = 'ACTIVE')
SELECT person_id, goal_id, s.key AS category, CAST(spent AS DECIMAL(19,2)) AS spent, target_amount AS "limit", CAST(spent - target_amount AS DECIMAL(19,2)) AS excess FROM g JOIN s ON s.person_id = g.owner_id AND s.key = g.key WHERE spent > target_amount""")
def _(tx, goals):
    return D.budget_exceeded(base_cube(tx), goals, "2000-06-01")


@query("flt8_reducible", "tx", sql="SELECT DISTINCT category, NOT regexp_matches(lower(category), 'moradia|aluguel|saude|educacao|housing|health|education|rent') AS reducible FROM tx WHERE category IS NOT NULL")
def _(tx):
    return tx.where("category is not null").select("category").distinct().withColumn("reducible", D.is_reducible(F.col("category")))


@query("flt8_reducible_words", "tx", sql="SELECT DISTINCT category, NOT regexp_matches(lower(category), 'econ|plate|brush') AS reducible FROM tx WHERE category IS NOT NULL")
def _(tx):
    return D.reducible(tx.where("category is not null").select("category").distinct(), _words(tx, *[("essential", w) for w in ("econ", "plate", "brush")]))
