"""Queries: text sources and parsed rows. Texts are written from the tables, so that what is parsed is known."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import estimated_due, parse_date
from tallyspark.functions.money import brazilian, parse_brazilian, parse_loose
from tallyspark.functions.shared import saved
from tallyspark.operators import ingesting as G
from tallyspark.plans.registry import ORACLES, QUERIES, pct_sql, query
from tallyspark.sources import texts as X
from tallyspark.sources.testdata import AS_OF


def _joined(lines, head: str):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(F.lit(head), body).alias("text"))


def _exports(tx):
    pt = F.concat_ws(",", F.date_format("transaction_date", "dd/MM/yyyy"), "description", F.when(F.col("type") == "INCOME", -F.col("amount")).otherwise(F.col("amount")).cast("string"), F.coalesce("category", F.lit("")))
    en = F.concat_ws(",", "description", F.col("amount").cast("string"), F.coalesce("category", F.lit("")), F.col("transaction_date").cast("string"), "type")
    odd = F.col("person_id") % 2 == 1
    lines = tx.select(F.col("person_id").alias("doc_id"), F.col("tx_id").alias("line_no"), F.when(odd, en).otherwise(pt).alias("line"))
    text = F.concat_ws("\n", F.when(F.col("doc_id") % 2 == 1, "\ufeffdescription,amount,category,date,type").otherwise("data,descricao,valor,categoria"), "text", F.lit("no,row"))
    return _joined(lines, "").withColumn("text", text)


@query("src1_csv_exports", "tx", sql="SELECT person_id AS doc_id, CASE WHEN person_id % 2 = 1 THEN 'en' ELSE 'pt' END AS layout, transaction_date AS date, description, amount, coalesce(category, '') AS category, type FROM tx")
def _(tx):
    return X.parse_exports(_exports(tx))[0].select("doc_id", "layout", "date", "description", "amount", "category", "type")


@query("src1_rejected_lines", "tx", sql="SELECT DISTINCT person_id AS doc_id, 'no,row' AS line FROM tx")
def _(tx):
    return X.parse_exports(_exports(tx))[1].select("doc_id", "line")


_STX = """WITH b AS (SELECT concat(o_custkey, '/', strftime(o_orderdate, '%Y-%m')) AS doc_id, o_orderkey, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS description, CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(19,2)) AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice * 2 AS DECIMAL(19,2)) END AS balance, CASE WHEN o_orderpriority = '1-URGENT' THEN 'CREDIT' ELSE 'DEBIT' END AS type FROM orders)
"""


@query("src3_statement_text", "text_lines", sql=_STX + "SELECT doc_id, date, description, amount, balance, type FROM b")
def _(lines):
    return X.parse_statement_text(_joined(lines, "Saldo anterior 100,00\nlançamentos\n")).select("doc_id", "date", "description", "amount", "balance", "type")


@query("wn7_running_balance", "text_lines", sql=_STX + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY date, o_orderkey) AS k FROM b), s AS (SELECT *, max(CASE WHEN balance IS NOT NULL THEN k END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS last FROM o)
SELECT a.doc_id, a.date, a.amount, CAST(coalesce(a.balance, coalesce((SELECT balance FROM o WHERE o.doc_id = a.doc_id AND o.k = a.last), 0) + (SELECT sum(amount) FROM o WHERE o.doc_id = a.doc_id AND o.k <= a.k AND o.k > coalesce(a.last, 0))) AS DECIMAL(19,2)) AS filled FROM s a""")
def _(lines):
    return X.fill_balances(X.parse_statement_text(_joined(lines, "lançamentos\n"))).select("doc_id", "date", "amount", "filled")


def _invoice_docs(parsed):
    p = parsed.where("date is not null and amount > 0")
    money = F.regexp_replace(F.translate(F.format_number(F.col("amount"), 2), ",.", ".,"), "^", "")
    months = F.array(*[F.lit(m) for m in "JAN FEV MAR ABR MAI JUN JUL AGO SET OUT NOV DEZ".split()])
    worded = F.concat(F.date_format("date", "dd"), F.lit(" "), F.element_at(months, F.month("date")), F.lit(" "), "description", F.when(F.col("type") == "INCOME", " -R$ ").otherwise(" R$ "), money)
    slashed = F.concat(F.date_format("date", "dd/MM"), F.lit(" "), "description", F.when(F.col("installment_number").isNotNull(), F.concat(F.lit(" parcela "), F.col("installment_number").cast("string"), F.lit(" de 12"))).otherwise(""), F.lit(" R$ "), F.when(F.col("type") == "INCOME", "-").otherwise(""), money)
    lines = p.select("doc_id", "line_no", "person_id", "due_date", F.when(F.col("doc_id") % 2 == 0, worded).otherwise(slashed).alias("line"))
    # one grouping of lines: heads and persons of their own would take a reading of the tables each
    head = lambda due: F.concat(F.when(F.col("doc_id") % 2 == 0, "fatura de cartão\nvencimento ").otherwise("mercado\nvencimento "), F.date_format(due, "dd/MM/yyyy"))
    heads = F.array_sort(F.transform(F.collect_set("due_date"), head))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id").agg(F.array_join(F.concat(heads, body), "\n").alias("text"), F.min("person_id").alias("person_id"))


def _layouts(df):
    return df.sparkSession.createDataFrame(X.LAYOUTS, X.LAYOUT_SCHEMA)


_INV = """WITH p AS (SELECT *, TRY_CAST((year(due_date) - CASE WHEN month(date) > month(due_date) THEN 1 ELSE 0 END) || '-' || month(date) || '-' || day(date) AS DATE) AS d FROM parsed WHERE date IS NOT NULL AND amount > 0)
"""


@query("src4_sf24_invoice_text", "parsed", sql=_INV + "SELECT doc_id, d AS date, description, amount, type, CASE WHEN doc_id % 2 = 1 THEN installment_number END AS installment_number, due_date FROM p")
def _(parsed):
    docs = saved(_invoice_docs(parsed), "invoice-docs")
    found = saved(X.parse_invoice_text(docs, _layouts(parsed)), "invoice-rows")
    chosen = X.select_layout(docs, found, _layouts(parsed))
    return found.join(chosen, ["doc_id", "layout"]).select("doc_id", "date", "description", "amount", "type", "installment_number", "due_date")


@query("src5_select_layout", "parsed", sql="SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'worded' ELSE 'slashed' END AS layout, 1100000 + CAST(10000 + least(5000, 20 * count(*)) AS BIGINT) AS score FROM parsed WHERE date IS NOT NULL AND amount > 0 GROUP BY doc_id")
def _(parsed):
    docs = saved(_invoice_docs(parsed), "invoice-docs")
    return X.select_layout(docs, X.parse_invoice_text(docs, _layouts(parsed)), _layouts(parsed))


@query("src6_dedup_uploads", "payments", sql="""WITH f AS (SELECT payment_id AS file_id, user_id AS person_id, sha256(CAST(user_id % 7 AS VARCHAR)) AS sha256, CASE WHEN payment_id % 4 = 0 THEN 'pw' END AS password FROM payments),
j AS (SELECT *, row_number() OVER (PARTITION BY person_id, sha256 ORDER BY paid_at DESC, file_id DESC) AS r FROM f JOIN payments ON payment_id = file_id)
SELECT f.person_id, f.sha256, f.file_id, CASE WHEN j.status <> 'PENDING' AND f.password IS NOT DISTINCT FROM j.password THEN j.file_id END AS reused_job FROM f LEFT JOIN j ON j.person_id = f.person_id AND j.sha256 = f.sha256 AND r = 1""")
def _(payments):
    files = payments.select(F.col("payment_id").alias("file_id"), F.col("user_id").alias("person_id"), F.sha2((F.col("user_id") % 7).cast("string"), 256).alias("sha256"), F.when(F.col("payment_id") % 4 == 0, "pw").alias("password"), F.lit(None).cast("date").alias("due_date"), "paid_at", "status")
    jobs = files.select("person_id", "sha256", F.col("file_id").alias("job_id"), F.when(F.col("status") == "PENDING", "FAILED").otherwise("DONE").alias("status"), "password", "due_date", F.col("paid_at").alias("created_at"))
    return X.dedup_uploads(files.drop("status", "paid_at"), jobs)


@query("flt13_drop_non_purchases", "parsed", sql="SELECT doc_id, line_no, description FROM parsed WHERE NOT (layout % 2 = 0 AND (contains(description, 'gear') OR contains(description, 'small'))) AND NOT (layout % 2 = 1 AND contains(description, 'ring'))")
def _(parsed):
    patterns = parsed.sparkSession.createDataFrame([(0, "gear"), (0, "small"), (1, "ring")], "layout bigint, pattern string")
    return G.drop_non_purchases(parsed.withColumn("layout", F.col("layout") % 2), patterns).select("doc_id", "line_no", "description")


@query("so2_remove_duplicates", "parsed", sql="SELECT doc_id, card_name, date, amount, type, trim(lower(description)) AS description FROM parsed GROUP BY ALL")
def _(parsed):
    return G.remove_duplicates(parsed, "drop").select("doc_id", "card_name", "date", "amount", "type", F.trim(F.lower("description")).alias("description")).distinct()


@query("so9_dedupe_installments", "parsed", sql="""WITH k AS (SELECT doc_id % 50 AS doc, doc_id * 10 + line_no AS n, installment_number AS i, card_name, description FROM parsed),
f AS (SELECT *, first_value(i) OVER (PARTITION BY doc, card_name, description ORDER BY n, i) AS fi FROM k)
SELECT doc AS doc_id, card_name, description, n AS line_no FROM f QUALIFY row_number() OVER (PARTITION BY doc, card_name, description ORDER BY CASE WHEN fi IS NULL THEN n ELSE coalesce(i, 1073741824) END, n) = 1""")
def _(parsed):
    rows = parsed.select((F.col("doc_id") % 50).alias("doc_id"), (F.col("doc_id") * 10 + F.col("line_no")).alias("line_no"), "installment_number", "card_name", "description", F.lit(1).alias("amount"), F.lit("2000-01-01").cast("date").alias("date"))
    return G.dedupe_installments(rows).select("doc_id", "card_name", "description", "line_no")


@query("so8_disambiguate", "parsed", sql="SELECT doc_id % 20 AS doc_id, line_no, CASE WHEN count(*) OVER (PARTITION BY doc_id % 20, card_name, type, description) > 1 THEN description || ' ' || line_no ELSE description END AS description FROM parsed")
def _(parsed):
    rows = parsed.select((F.col("doc_id") % 20).alias("doc_id"), "line_no", "card_name", "type", "description", F.lit(1).alias("amount"), F.lit("2000-01-01").cast("date").alias("date"), F.col("line_no").alias("time"))
    return G.disambiguate(rows).select("doc_id", "line_no", "description")


@query("so7_cancel_refunds", "parsed", sql="""WITH r AS (SELECT doc_id % 300 AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id, line_no, description, amount) AS INT) AS line_no, CASE WHEN type = 'INCOME' THEN 'Estorno tarifa' ELSE 'Tarifa' END AS description, type = 'INCOME' AS refund FROM parsed),
s AS (SELECT *, sum(CASE WHEN refund THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS s FROM r),
m AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
f AS (SELECT *, NOT refund AND s >= low AS taken, row_number() OVER (PARTITION BY doc_id, refund ORDER BY line_no) AS nth FROM m),
t AS (SELECT doc_id AS d, count(*) FILTER (taken) AS n FROM f GROUP BY 1)
SELECT doc_id, line_no, description, CAST(1 AS INT) AS amount, DATE '2000-01-01' AS date FROM f JOIN t ON d = doc_id WHERE NOT taken AND NOT (refund AND nth <= n)""")
def _(parsed):
    name = F.when(F.col("type") == "INCOME", "Estorno tarifa").otherwise("Tarifa")
    # the SQL leaves the order of rows that differ in type alone open; numbers are made twice, so they may not hang on how rows arrive: the fee comes first, as in the operator
    order = F.row_number().over(Window.partitionBy(F.col("doc_id") % 300).orderBy("doc_id", "line_no", "description", "amount", "type"))
    rows = parsed.select((F.col("doc_id") % 300).alias("doc_id"), order.alias("line_no"), name.alias("description"), F.lit(1).alias("amount"), F.lit("2000-01-01").cast("date").alias("date"))
    return G.cancel_refunds(rows)


@query("wn14_carry_context", "text_lines", sql="""WITH o AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 4 = 0 THEN regexp_extract(line, '\\d{4} (.*?) [\\d.]+,', 1) END AS h FROM text_lines)
SELECT doc_id, line_no, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS context FROM o""")
def _(lines):
    marked = lines.withColumn("line", F.when(F.col("line_no") % 4 == 0, F.col("line")).otherwise(""))
    return G.carry_context(marked, r"\d{4} (.*?) [\d.]+,").select("doc_id", "line_no", "context")


@query("wn15_join_split_entries", "text_lines", sql="SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS entry, trim(replace(line, ' ', '  ')) AS text FROM text_lines")
def _(lines):
    halves = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("i", "line")).select("doc_id", (F.col("line_no") * 10 + F.col("i")).alias("line_no"), F.concat("line", F.lit(" ")).alias("line"))
    joined = G.join_split_entries(halves, r"^\d{2}/\d{2}/\d{4} ")
    return joined.select("doc_id", "entry", F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))


@query("wn13_sf9_expected_total", "parsed", sql="SELECT doc_id, max(document_total) AS expected FROM parsed WHERE document_total > 0 GROUP BY doc_id")
def _(parsed):
    one = parsed.groupBy("doc_id").agg(F.max("document_total").alias("t"))
    money = F.translate(F.format_number("t", 2), ",.", ".,")
    text = F.concat(F.lit("Fatura anterior total da fatura 9,99\nTotal da fatura\nem reais\n"), money, F.lit("\nparcelamento\ntotal a pagar 1,00\nTotal desta fatura "), money)
    return G.expected_total(X.lines_of(one.select("doc_id", text.alias("text"))))


_CAP = f"""WITH c AS (SELECT doc_id, CAST(coalesce(sum(CASE WHEN type = 'EXPENSE' THEN abs(amount) END), 0) AS DECIMAL(19,2)) AS captured, max(document_total) AS invoice_amount FROM parsed GROUP BY doc_id)
"""


@query("ag20_capture_summary", "parsed", sql=_CAP + f"""SELECT doc_id, captured, CAST(invoice_amount - captured AS DECIMAL(19,2)) AS difference, {pct_sql('captured', 'invoice_amount')} AS coverage, doc_id % 2 = 0 AND captured > 0 AS period_match,
  doc_id % 2 = 0 AND captured > 0 AND abs(invoice_amount - captured) > 1 AND doc_id % 3 <> 0 AS recommend FROM c WHERE invoice_amount > 0""")
def _(parsed):
    c = parsed.groupBy("doc_id").agg(F.sum(F.when(F.col("type") == "EXPENSE", F.col("amount"))).alias("s"), F.max("document_total").alias("invoice_amount"))
    docs = c.select("doc_id", "invoice_amount", F.lit(100).cast("decimal(19,2)").alias("previous_balance"), F.when(F.col("doc_id") % 3 == 0, 100).otherwise(20).cast("decimal(19,2)").alias("credits_payments"), F.when(F.col("doc_id") % 2 == 0, F.col("s")).alias("purchases_debits"))
    return G.capture_summary(parsed, docs).select("doc_id", "captured", "difference", "coverage", "period_match", "recommend")


@query("ag21_parse_quality", "parsed", sql="""WITH c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (date IS NOT NULL AND amount > 0) AS v, count(*) FILTER (amount = 0) AS bad, max(document_total) AS t FROM parsed GROUP BY doc_id),
s AS (SELECT doc_id, CAST(greatest(0, least(100, CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN t > 0 THEN 20 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN n >= 3 THEN 20 ELSE -25 END + CASE WHEN v * 100 >= n * 80 THEN 30 ELSE 0 END
  - CASE WHEN doc_id % 5 = 0 THEN 30 ELSE 0 END - CASE WHEN bad > 0 THEN 15 ELSE 0 END)) AS INT) AS score FROM c) SELECT *, score >= 90 AS accepted, score >= 75 AS high_quality FROM s""")
def _(parsed):
    docs = parsed.groupBy("doc_id").agg(F.max("document_total").alias("total_amount")).select(
        "doc_id", "total_amount", F.when(F.col("doc_id") % 5 == 0, "short").otherwise(F.repeat(F.lit("text "), 200)).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(AS_OF).cast("date")).alias("due_date"), F.when(F.col("doc_id") % 3 == 0, "1234").alias("last_four"))
    return G.parse_quality(docs, parsed)


@query("ag22_reconcile", "parsed", sql=_CAP + """, h AS (SELECT doc_id, count(*) AS n, coalesce(sum(amount) FILTER (type = 'EXPENSE'), 0) AS t, count(*) FILTER (installment_number IS NOT NULL) AS m, coalesce(sum(amount) FILTER (type = 'EXPENSE' AND installment_number IS NOT NULL), 0) AS u FROM parsed GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN invoice_amount > 0 AND (n >= m AND abs(invoice_amount - t) < abs(invoice_amount - u) OR n > m AND abs(invoice_amount - t) <= abs(invoice_amount - u)) THEN 'second' ELSE 'first' END AS chosen FROM c JOIN h ON h.doc_id = c.doc_id""")
def _(parsed):
    expected = parsed.groupBy("doc_id").agg(F.max("document_total").alias("expected"))
    return G.reconcile_extractions(parsed.where("installment_number is not null"), parsed, expected)


@query("ag22_missing_rows", "parsed", sql=_CAP + "SELECT doc_id, captured, invoice_amount AS expected, captured * 100 < invoice_amount * 96 AS retry FROM c WHERE captured > 0 AND invoice_amount > 0")
def _(parsed):
    return G.missing_rows(parsed, parsed.groupBy("doc_id").agg(F.max("document_total").alias("expected")))


@query("ag25_choose_extraction", "parsed", sql="""WITH a AS (SELECT doc_id, count(*) * 20 AS first_score, CASE WHEN count(*) FILTER (type = 'EXPENSE') > 0 THEN count(DISTINCT card_name) FILTER (type = 'EXPENSE') * 25 END AS second_score FROM parsed GROUP BY doc_id)
SELECT *, CASE WHEN first_score < 75 AND coalesce(second_score >= first_score + 20, false) THEN 'second' ELSE 'first' END AS chosen FROM a""")
def _(parsed):
    a = parsed.groupBy("doc_id").agg((F.count("*") * 20).alias("score"))
    b = parsed.where("type = 'EXPENSE'").groupBy("doc_id").agg((F.count_distinct("card_name") * 25).alias("score"))
    return G.choose_extraction(a, b)


@query("ag23_upload_summary", "parsed", sql="""SELECT doc_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n,
  CASE WHEN count(DISTINCT card_name || year(due_date) || month(due_date)) = 1 AND max(stated) > 0 THEN max(stated) ELSE CAST(sum(CASE WHEN doc_id % 2 = 0 AND type <> 'EXPENSE' THEN -amount ELSE amount END) AS DECIMAL(19,2)) END AS total, CAST(sum(CASE WHEN doc_id % 2 = 0 AND type <> 'EXPENSE' THEN -amount ELSE amount END) AS DECIMAL(19,2)) AS summed
  FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE document_total END AS stated FROM parsed) GROUP BY doc_id""")
def _(parsed):
    stated = F.when(F.col("doc_id") % 5 == 0, 0).when(F.col("doc_id") % 5 > 1, F.col("document_total")).cast("decimal(19,2)")
    return G.upload_summary(parsed.withColumn("document_total", stated), F.col("doc_id") % 2 == 0)


@query("sf8_sf15_money", "tx", sql="SELECT tx_id, amount AS parsed, CASE WHEN type = 'INCOME' THEN -amount ELSE amount END AS trailing, amount AS loose FROM tx")
def _(tx):
    text = brazilian(F.col("amount"))
    trailing = F.when(F.col("type") == "INCOME", F.concat(text, F.lit("−"))).otherwise(text)
    return tx.select("tx_id", parse_brazilian(text).alias("parsed"), parse_brazilian(trailing).alias("trailing"), parse_loose(F.col("amount").cast("string")).alias("loose"))


@query("sf10_dates", "tx", sql=f"""SELECT tx_id, transaction_date AS iso, transaction_date AS slashed, CAST(CASE WHEN year(transaction_date) < 2000 THEN transaction_date + INTERVAL 100 YEAR ELSE transaction_date END AS DATE) AS short, CAST(CASE WHEN make_date(2000, CAST(month(transaction_date) AS INT), CAST(day(transaction_date) AS INT)) > DATE '2000-07-30' THEN make_date(1999, CAST(month(transaction_date) AS INT), CAST(day(transaction_date) AS INT)) ELSE make_date(2000, CAST(month(transaction_date) AS INT), CAST(day(transaction_date) AS INT)) END AS DATE) AS yearless FROM tx""")
def _(tx):
    d, today = F.col("transaction_date"), F.lit(AS_OF).cast("date")
    parse = lambda f: parse_date(F.date_format(d, f), today)
    return tx.select("tx_id", parse("yyyy-MM-dd").alias("iso"), parse("dd/MM/yyyy").alias("slashed"), parse("dd/MM/yy").alias("short"), F.when(F.dayofmonth(d) % 2 == 0, parse("dd/MM")).otherwise(parse("dd MMM")).alias("yearless"))


@query("sf11_installments", "parsed", sql="SELECT doc_id, line_no, CASE WHEN line_no <= 6 THEN line_no END AS number, CASE WHEN line_no <= 6 THEN 6 END AS total, CAST(lower('VISA') AS VARCHAR) AS brand, lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS last_four, CAST(date_trunc('month', due_date) + INTERVAL 1 MONTH AS DATE) + CASE WHEN line_no BETWEEN 1 AND 28 THEN line_no ELSE 10 END - 1 AS due FROM parsed")
def _(parsed):
    text = F.concat("description", F.lit(" "), F.col("line_no").cast("string"), F.lit("/6"))
    i = G.installment(text)
    card = G.card_identity(F.lit("card"), F.concat(F.lit("VISA-"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(".csv")))
    return parsed.select("doc_id", "line_no", i["number"].alias("number"), i["total"].alias("total"), card["brand"].alias("brand"), card["last_four"].alias("last_four"), estimated_due(F.col("due_date"), F.col("line_no")).alias("due"))


@query("sf23_statement_amounts", "stx", sql="SELECT stx_id, CASE WHEN stx_id % 3 = 0 THEN CASE WHEN stx_id % 2 = 0 THEN 'CREDIT' ELSE 'DEBIT' END ELSE type END AS type, CAST(CASE WHEN CASE WHEN stx_id % 3 = 0 THEN stx_id % 2 = 0 ELSE type = 'CREDIT' END THEN abs(amount) ELSE -abs(amount) END AS DECIMAL(19,2)) AS amount FROM stx WHERE stx_id % 3 = 0 OR type <> 'BALANCE'")
def _(stx):
    rows = stx.select("stx_id", F.when(F.col("stx_id") % 3 != 0, F.col("type")).alias("type"), "amount", F.when(F.col("stx_id") % 2 == 0, "paid + R$ 3").otherwise("paid - R$ 3").alias("text"))
    return G.statement_amounts(rows).select("stx_id", "type", "amount")


def _read_orders(spark, sf_dir):
    return X.read_table(spark, "orders.parquet", base=sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


QUERIES["src2_read_table"] = _read_orders
ORACLES["src2_read_table"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
