"""Queries: streams over the events table, run over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.shared import new_folder
from tallyspark.plans.registry import ORACLES, QUERIES, query
from tallyspark.streaming import audit as A


def _events(spark, sf_dir):
    return A.event_stream(spark, sf_dir).withColumn("action", F.col("event_type")).withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 50).cast("string")))


def st1(spark, sf_dir):
    return A.run_now(A.sliding_counts(_events(spark, sf_dir)), ["start", "user_id", "action"])


QUERIES["st1_sliding_counts"] = st1
ORACLES["st1_sliding_counts"] = """SELECT CAST(time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(10 * k AS INT)) AS TIMESTAMP) AS start, user_id, event_type AS action, count(*) AS n FROM events CROSS JOIN range(6) r(k) GROUP BY ALL"""


def st3(spark, sf_dir):
    uploads = _events(spark, sf_dir).select("ts", F.col("user_id").alias("person_id"), F.sha2(F.col("event_type"), 256).alias("sha256"))
    return A.run_now(A.unique_uploads(uploads), [], "append").select("person_id", "sha256")


QUERIES["st3_unique_uploads"] = st3
ORACLES["st3_unique_uploads"] = "SELECT DISTINCT user_id AS person_id, sha256(event_type) AS sha256 FROM events"


def st4(spark, sf_dir):
    tx = _events(spark, sf_dir).select("ts", F.col("user_id").alias("person_id"), F.when(F.col("event_type") == "purchase", "EXPENSE").otherwise("INCOME").alias("type"), F.col("value").cast("decimal(19,2)").alias("amount"))
    return A.run_now(A.running_totals(tx), ["person_id", "month", "type"])


QUERIES["st4_running_totals"] = st4
ORACLES["st4_running_totals"] = """SELECT user_id AS person_id, CAST(date_trunc('month', ts) AS DATE) AS month, CASE WHEN event_type = 'purchase' THEN 'EXPENSE' ELSE 'INCOME' END AS type, CAST(sum(CAST(value AS DECIMAL(19,2))) AS DECIMAL(19,2)) AS total, count(*) AS n FROM events GROUP BY ALL"""


def st4_corrections(spark, sf_dir):
    """Every event is a change of one of its user's seven rows; of the newest versions, those that aren't deleted count. Changes
    come in six files in the order of a hash, a micro-batch each, so older versions come after newer ones."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = F.col
    changes = events.select(
        F.concat_ws("-", "user_id", (c("event_id") % 7).cast("string")).alias("tx_id"), c("event_id").alias("version"), c("user_id").alias("person_id"), F.to_date("ts").alias("transaction_date"), F.when(c("event_type") == "purchase", "EXPENSE").otherwise("INCOME").alias("type"),
        c("event_type").alias("category"), c("value").cast("decimal(19,2)").alias("amount"), (c("event_type") == "error").alias("deleted"), c("event_type").alias("description"),
    )
    source = new_folder(spark, "changes")
    changes.repartition(6, "version").write.parquet(source)
    kept = A.CorrectedTotals(spark, new_folder(spark, "corrected"), every=2)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    kept.start(stream, dict(threshold=300, risky=["view"], keywords=["click"])).awaitTermination()
    return kept.totals()


QUERIES["st4_corrections"] = st4_corrections
ORACLES["st4_corrections"] = """WITH c AS (SELECT user_id, event_id, ts, event_type, CAST(value AS DECIMAL(19,2)) AS amount FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id DESC) = 1)
SELECT user_id AS person_id, CAST(date_trunc('month', ts) AS DATE) AS month, CASE WHEN event_type = 'purchase' THEN 'EXPENSE' ELSE 'INCOME' END AS type, CAST(sum(amount) AS DECIMAL(19,2)) AS total, count(*) AS n, count(*) FILTER (amount >= 300 OR event_type IN ('view', 'click')) AS n_critical FROM c WHERE event_type <> 'error' GROUP BY ALL"""


_QUOTA = """WITH RECURSIVE w AS (SELECT ip, min(ts) AS ts FROM audit GROUP BY ip UNION ALL SELECT ip, n FROM (SELECT w.ip, (SELECT min(a.ts) FROM audit a WHERE a.ip = w.ip AND a.ts >= w.ts + INTERVAL 6 HOUR) AS n FROM w) WHERE n IS NOT NULL),
j AS (SELECT a.event_id, a.ip AS key, w.ts AS anchor, a.ts FROM audit a ASOF JOIN w ON w.ip = a.ip AND a.ts >= w.ts)
SELECT event_id, key, row_number() OVER (PARTITION BY key, anchor ORDER BY ts, event_id) <= 2 AS allowed FROM j"""


@query("st2_quota", "audit", sql=_QUOTA)
def _(audit):
    return A.quota(audit, "ip", limit=2, seconds=6 * 3600)


@query("st2_quota_slices", "audit", sql=_QUOTA)
def _(audit):
    """The same with every key cut into slices of time."""
    return A.quota(audit, "ip", limit=2, seconds=6 * 3600, folded=0)
