"""Parsed rows of uploads: cleaning, instalments, totals, quality and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import MONEY, percent, total, total_if
from tallyspark.functions.sizes import grows, small
from tallyspark.functions.text import is_garbled, normalize


def installment(description: Column) -> Column:
    """(number, total) of n/m or n x m in a description, where 1 <= n <= m."""
    n = F.nullif(F.regexp_extract(description, r"(?i)(?:^|[^\d/])(\d{1,2})\s*(?:/|x|de)\s*(\d{1,2})(?:[^\d/]|$)", 1), F.lit("")).try_cast("int")
    m = F.nullif(F.regexp_extract(description, r"(?i)(?:^|[^\d/])(\d{1,2})\s*(?:/|x|de)\s*(\d{1,2})(?:[^\d/]|$)", 2), F.lit("")).try_cast("int")
    ok = (n >= 1) & (n <= m)
    return F.struct(F.when(ok, n).alias("number"), F.when(ok, m).alias("total"))


#: Card networks by the words that name them, the first that occurs; fixed values.
NETWORKS = [("visa", "visa"), ("mastercard", "mastercard"), ("master", "mastercard"), ("elo", "elo"), ("amex", "amex"), ("american express", "amex"), ("hipercard", "hipercard"), ("diners", "diners")]


def card_identity(card_name: Column, file_name: Column, brands: list[tuple[str, str]] = NETWORKS) -> Column:
    """(brand, last four digits) from the card's name, else the file's. brands: words and the brand that each stands for, in order.
    The digits are the last four that no digit follows, else those after 'final'."""
    brand = lambda x: F.coalesce(*[F.when(F.contains(F.lower(x), F.lit(word)), F.lit(name)) for word, name in brands])
    digits = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))
    last = lambda x: F.coalesce(digits(x, r"(?s)(\d{4})(?!.*\d)"), digits(x, r"(?i)final\s*(\d{4})"))
    return F.struct(F.coalesce(brand(card_name), brand(file_name)).alias("brand"), F.coalesce(last(card_name), last(file_name)).alias("last_four"))


def drop_non_purchases(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows whose description fits none of their layout's patterns (layout, pattern)."""
    joined = patterns.groupBy("layout").agg(F.concat_ws("|", F.array_sort(F.collect_list("pattern"))).alias("p"))
    return rows.join(small(joined), "layout", "left").where("p is null or not lower(description) rlike p").drop("p")


KEY = ["doc_id", "card_name", "date", "amount", "type"]


def remove_duplicates(rows: DataFrame, mode: str = "keep") -> DataFrame:
    """mode drop: one of rows that agree in document, card, date, amount, type and normalised description."""
    return rows if mode == "keep" else rows.withColumn("__d", normalize(F.col("description"))).dropDuplicates([*KEY, "__d"]).drop("__d")


def dedupe_installments(rows: DataFrame) -> DataFrame:
    """One row per document, card, date, amount and description: the first line; where a kept row and a later
    one both have instalment numbers, the smaller. So a first line without one stays."""
    key = ["doc_id", "card_name", "date", "amount", "d"]
    group = Window.partitionBy(*key)
    some = rows.withColumn("d", normalize(F.col("description"))).withColumn("first", F.min(F.struct("line_no", "installment_number")).over(group)["installment_number"])
    order = F.when(F.col("first").isNull(), F.col("line_no")).otherwise(F.coalesce(F.col("installment_number"), F.lit(1 << 30)))
    return some.withColumn("r", F.row_number().over(group.orderBy(order, "line_no"))).where("r = 1").drop("d", "first", "r")


def disambiguate(rows: DataFrame) -> DataFrame:
    """Where rows agree in all of the duplicate key, each gets its time of day appended to the description."""
    same = Window.partitionBy(*KEY, "description")
    return rows.withColumn("description", F.when(F.count("*").over(same) > 1, F.concat_ws(" ", "description", F.col("time").cast("string"))).otherwise(F.col("description")))


def cancel_refunds(rows: DataFrame) -> DataFrame:
    """Drops each refund of a fee and the first later fee of its document, date and amount that no
    refund before it took. Only refunds and fees are grouped, and a group is a sort, not an array: it may be of any size.

    A fee is taken while refunds wait. Those waiting are the refunds so far less the fees, where fees that found none waiting don't count:
    these are as many as the running balance has fallen below zero. Refunds are taken in their order, as many as fees are."""
    c, d = F.col, normalize(F.col("description"))
    fee = d.contains("tarifa") | d.contains("anuidade")
    marked = rows.where(fee).select("doc_id", "date", "amount", "line_no", F.coalesce(d.contains("estorno"), F.lit(False)).alias("refund"))
    group = Window.partitionBy("doc_id", "date", "amount").orderBy("line_no", "refund")
    upto = group.rowsBetween(Window.unboundedPreceding, 0)
    walked = marked.withColumn("balance", F.sum(F.when(c("refund"), 1).otherwise(-1)).over(upto))
    walked = walked.withColumn("low", F.least(F.lit(0), F.coalesce(F.min("balance").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    walked = walked.withColumn("taken", ~c("refund") & (c("balance") >= c("low"))).withColumn("nth", F.count_if("refund").over(upto))
    taken = F.count_if("taken").over(Window.partitionBy("doc_id", "date", "amount"))
    gone = walked.withColumn("n", taken).where(c("taken") | (c("refund") & (c("nth") <= c("n")))).select("doc_id", "line_no")
    return rows.join(gone, ["doc_id", "line_no"], "left_anti")


def carry_context(lines: DataFrame, header: str) -> DataFrame:
    """Each line with the last header at or above it (first group of the expression), null before the first."""
    found = F.nullif(F.regexp_extract("line", header, 1), F.lit(""))
    return lines.withColumn("context", F.last(found, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("line_no")))


def join_split_entries(lines: DataFrame, start: str = r"^\d{2}/\d{2} ") -> DataFrame:
    """Lines of one entry, from a dated line to the next, as one text."""
    entry = F.count_if(F.col("line").rlike(start)).over(Window.partitionBy("doc_id").orderBy("line_no"))
    groups = lines.withColumn("entry", entry).where("entry > 0").groupBy("doc_id", "entry").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return groups.select("doc_id", "entry", F.array_join(F.transform("ls", lambda x: F.trim(x["line"])), " ").alias("text"))


def expected_total(lines: DataFrame) -> DataFrame:
    """(doc_id, expected): the amount on or up to four lines below a label of a total; strong labels before
    'total a pagar', which doesn't count near instalment plans; the most frequent, the larger on ties."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    near = F.array_join(F.collect_list(F.lower("line")).over(order.rowsBetween(-1, 2)), " ")
    money = r"((?:\d{1,3}(?:\.\d{3})+|\d+),\d{2})"
    values = F.collect_list(F.regexp_extract_all("line", F.lit(money), F.lit(1))).over(order.rowsBetween(0, 4))
    low = F.lower("line")
    strong = low.rlike(r"valor da fatura|total da fatura|total fatura|total desta fatura|chegou no valor|lan[cç]amentos atuais|\(\+\)\s*compras\s*/\s*d[eé]bitos")
    weak = low.contains("total a pagar")
    first = F.get(F.filter(F.transform(F.flatten("values"), lambda v: F.regexp_replace(F.regexp_replace(v, r"\.", ""), ",", ".").cast(MONEY)), lambda v: v > 0), F.lit(0))
    found = lines.withColumn("near", near).withColumn("values", values).where((strong | weak) & ~low.contains("fatura anterior"))
    found = found.withColumn("value", first).withColumn("strong", strong).where("value is not null").where(F.col("strong") | ~F.col("near").rlike(r"parcelamento|simula|entrada \+"))
    counts = found.groupBy("doc_id", "strong", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.max_by("value", F.struct("strong", "n", "value")).alias("expected"))


def capture_summary(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Captured expenses against an invoice's amounts; docs: doc_id, invoice_amount, previous_balance,
    credits_payments, purchases_debits. Recommended to look at: the period fits, the whole doesn't, and something was left."""
    captured = rows.groupBy("doc_id").agg(total_if(F.col("type") == "EXPENSE", F.abs("amount")).alias("captured"))
    c = F.col
    out = docs.where("invoice_amount > 0").join(captured, "doc_id", "left").withColumn("captured", F.coalesce("captured", F.lit(0)).cast(MONEY))
    out = out.withColumn("difference", (c("invoice_amount") - c("captured")).cast(MONEY)).withColumn("coverage", percent(c("captured"), c("invoice_amount")))
    out = out.withColumn("previous_outstanding", (c("previous_balance") - c("credits_payments")).cast(MONEY))
    match = F.coalesce((c("purchases_debits") > 0) & (F.abs(c("purchases_debits") - c("captured")) <= 1), F.lit(False))
    out = out.withColumn("period_match", match)
    return out.withColumn("recommend", c("period_match") & (F.abs("difference") > 1) & F.coalesce(F.abs("previous_outstanding") > 1, F.lit(False)))


def parse_quality(docs: DataFrame, rows: DataFrame, least_rows: int = 3, least_text: int = 800, accept: int = 90, high: int = 75) -> DataFrame:
    """Score 0 to 100 of an extraction; docs: doc_id, text, due_date, total_amount, last_four."""
    valid = F.col("date").isNotNull() & F.coalesce(F.col("amount") > 0, F.lit(False))
    bad = F.coalesce(F.col("amount") == 0, F.lit(True)) | (F.coalesce(F.trim("description"), F.lit("")) == "")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_if(bad).alias("bad"))
    c = F.col
    n = F.coalesce(c("n"), F.lit(0))
    text = F.coalesce(c("text"), F.lit(""))
    garbled = F.regexp_count(text, F.lit("[�□]")) * 20 > F.length(text)
    points = lambda cond, k: F.when(F.coalesce(cond, F.lit(False)), k).otherwise(0)
    score = (
        points(c("due_date").isNotNull(), 20) + points(c("total_amount") > 0, 20) + points(c("last_four").isNotNull(), 10) + points(n >= least_rows, 20) + points((n > 0) & (c("valid") * 100 >= n * 80), 30)
        - points(F.length("text") < least_text, 30) - points(garbled, 20) - points(n < least_rows, 25) - points(c("bad") > 0, 15)
    )
    out = docs.join(grows(counts), "doc_id", "left").withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    return out.select("doc_id", "score", (c("score") >= accept).alias("accepted"), (c("score") >= high).alias("high_quality"))


def missing_rows(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents that captured less than 96 per cent of what was expected."""
    sums = rows.groupBy("doc_id").agg(total_if(F.col("type") == "EXPENSE", F.abs("amount")).alias("captured"))
    return sums.join(expected, "doc_id").where("expected > 0 and captured > 0").withColumn("retry", F.col("captured") * 100 < F.col("expected") * 96)


def reconcile_extractions(a: DataFrame, b: DataFrame, expected: DataFrame) -> DataFrame:
    """Takes b where it has no fewer rows and is closer to the expected total, or more rows and is as close."""
    side = lambda x, s: x.groupBy("doc_id").agg(F.count("*").alias(f"n_{s}"), total_if(F.col("type") == "EXPENSE", F.abs("amount")).alias(f"t_{s}"))
    joined = expected.join(side(a, "a"), "doc_id", "left").join(side(b, "b"), "doc_id", "left").na.fill(0, ["n_a", "n_b", "t_a", "t_b"])
    da, db = F.abs(F.col("expected") - F.col("t_a")), F.abs(F.col("expected") - F.col("t_b"))
    better = (F.col("expected") > 0) & (((F.col("n_b") >= F.col("n_a")) & (db < da)) | ((F.col("n_b") > F.col("n_a")) & (db <= da)))
    return joined.select("doc_id", F.when(better, "second").otherwise("first").alias("chosen"))


def extraction_score(rows: DataFrame) -> DataFrame:
    """1000 a row, less 250 for a garbled description and for a missing date."""
    return rows.groupBy("doc_id").agg((F.count("*") * 1000 - F.count_if(is_garbled(F.col("description"))) * 250 - F.count_if(F.col("date").isNull()) * 250).alias("score"))


def choose_extraction(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: (doc_id, score). The second is tried below 75 and taken when 20 points better."""
    joined = a.select("doc_id", F.col("score").alias("first_score")).join(b.select("doc_id", F.col("score").alias("second_score")), "doc_id", "left")
    take = (F.col("first_score") < 75) & (F.col("second_score") >= F.col("first_score") + 20)
    return joined.withColumn("chosen", F.when(F.coalesce(take, F.lit(False)), "second").otherwise("first"))


def upload_summary(rows: DataFrame, net: Column) -> DataFrame:
    """Dates, count and total of each upload: signed (expenses less income) for net layouts, else the sum. The
    document's own total replaces it if it is positive and all rows are of one invoice: column invoice_key, without it card and due month."""
    key = F.col("invoice_key") if "invoice_key" in rows.columns else F.concat_ws("|", F.coalesce("card_name", F.lit("")), F.date_format(F.coalesce("due_date", "date"), "yyyy-MM"))
    signed = F.when(F.col("type") == "EXPENSE", F.col("amount")).otherwise(-F.col("amount"))
    sums = rows.groupBy("doc_id").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n"), total(F.when(net, signed).otherwise(F.col("amount"))).alias("summed"),
        F.max("document_total").alias("stated"), (F.min(key) == F.max(key)).alias("one_invoice"),
    )
    total_ = F.when(F.col("one_invoice") & (F.col("stated") > 0), F.col("stated")).otherwise(F.col("summed"))
    return sums.select("doc_id", "first_date", "last_date", "n", total_.cast(MONEY).alias("total"), "summed")


def statement_amounts(rows: DataFrame) -> DataFrame:
    """Signed amounts by type; a missing type comes from a sign at the currency mark in the text, else DEBIT. BALANCE rows go, null amounts are 0."""
    minus = F.col("text").rlike(r"-\s*R\$|R\$\s*-")
    kind = F.coalesce("type", F.when(minus, "DEBIT").when(F.col("text").rlike(r"\+\s*R\$|R\$\s*\+"), "CREDIT").otherwise("DEBIT"))
    size = F.abs(F.coalesce("amount", F.lit(0)))
    return rows.withColumn("type", kind).where("type <> 'BALANCE'").withColumn("amount", F.when(F.col("type") == "DEBIT", -size).otherwise(size).cast(MONEY))
