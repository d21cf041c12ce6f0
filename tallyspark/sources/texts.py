"""Sources that are text: CSV exports, statement text, invoice text; uploads; sinks.

Documents are rows (doc_id, text). Everything is JVM regular expressions over exploded lines.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import day_and_month, once, parse_date, try_date
from tallyspark.functions.money import MONEY, parse_brazilian, parse_loose
from tallyspark.functions.sizes import grows, small


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the non-blank lines; a byte order mark is dropped."""
    text = F.regexp_replace("text", "^\\ufeff", "")
    return docs.select("doc_id", F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


def read_table(spark: SparkSession, name: str, base: str | None = None, url: str | None = None, partition_column: str | None = None, partitions: int = 16, **options) -> DataFrame:
    """An operational table from Parquet, or over JDBC in partitions of about as many rows each, with filters pushed to the database.

    The column that parts the table is numeric or a date. Its quantiles are those of the table: it is read first, alone and in
    even steps from its smallest to its largest value. A value that more than a partition's share of the rows have is a partition
    of its own; nulls go with the first one."""
    if base:
        return spark.read.parquet(f"{base}/{name}")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if not partition_column:
        return reader.option("dbtable", name).load()
    return spark.read.jdbc(url, name, predicates=quantile_predicates(spark, reader, url, name, partition_column, partitions), properties=options)


def quantile_predicates(spark: SparkSession, reader: DataFrameReader, url: str, name: str, column: str, partitions: int) -> list[str]:
    """Conditions that part a table by a column: each of its rows, those with nulls too, fulfils one."""
    columns = reader.option("dbtable", name).load().columns
    plain = next(c for c in columns if c.lower() == column.lower())
    column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(plain)  # as the database has it
    low, high = reader.option("dbtable", f"(SELECT min({column}) AS low, max({column}) AS high FROM {name}) ends").load().first()
    if low is None or low == high:
        return ["1 = 1"]
    even = reader.options(dbtable=name, partitionColumn=plain, lowerBound=str(low), upperBound=str(high), numPartitions=partitions)
    ids = even.load().select(F.col(plain).alias("v")).where("v is not null")
    marks = ids.agg(F.percentile_approx("v", [i / partitions for i in range(1, partitions)], 10_000).alias("q")).first()[0]
    said = lambda v: f"'{v}'" if isinstance(v, (datetime.date, str)) else str(v)
    out, after = [], None  # after: a lower bound that is set
    for v in sorted(set(marks)):
        out.append(f"{column} < {said(v)}" if after is None else f"{after} AND {column} < {said(v)}")
        if marks.count(v) > 1:
            out.append(f"{column} = {said(v)}")
        after = f"{column} > {said(v)}" if marks.count(v) > 1 else f"{column} >= {said(v)}"
    return [f"{out[0]} OR {column} IS NULL", *out[1:], after]


def read_csv_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of the export files under a path, doc_id being the file's. Files are read in splits: a line's number comes from the
    numbers of lines in the splits before its own, and a file's first line that isn't blank goes to all of its lines by a join, a row a file."""
    c = F.col
    read = spark.read.text(path).select(c("_metadata.file_path").alias("doc_id"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), c("value").alias("line"))
    blocks = read.groupBy("doc_id", "block").agg(F.min("i").alias("low"), F.count("*").alias("n"))  # a row a split
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    clean = F.regexp_replace("line", "^\\ufeff", "")
    some = read.withColumn("line", clean).where(F.trim("line") != "")
    heads = some.groupBy("doc_id").agg(F.min(F.struct("block", "i", "line")).alias("head"))
    lines = some.join(blocks, ["doc_id", "block"]).join(heads, "doc_id").where((c("block") != c("head.block")) | (c("i") != c("head.i")))
    return _export_rows(lines.select("doc_id", (c("before") + c("i") - c("low")).cast("int").alias("line_no"), "line", c("head.line").alias("first")))


def parse_exports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines) of exports held as documents (doc_id, text); nothing is shuffled."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.regexp_replace(x, "^\\ufeff", ""))
    first = F.array_position(F.transform(lines, lambda x: F.trim(x) != ""), True) - 1
    split = files.select("doc_id", lines.alias("lines"), first.cast("int").alias("head")).select("doc_id", "head", F.when(F.col("head") >= 0, F.get("lines", F.col("head"))).alias("first"), F.posexplode("lines").alias("line_no", "line"))
    return _export_rows(split.where((F.trim("line") != "") & (F.col("line_no") != F.col("head"))).drop("head"))


def _export_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of three header layouts: full (card, date, description, amount, category, type), pt (data,
    descricao, valor, categoria) and en (description, amount, category, date[, type]). The first line that isn't
    blank selects the layout; commas always separate. Lines without date or amount are rejected."""
    c = F.col

    def read(r):
        layout, parts = r["layout"], r["parts"]
        at = lambda full, pt, en: F.trim(F.when(layout == "full", F.get(parts, F.lit(full))).when(layout == "pt", F.get(parts, F.lit(pt)) if pt is not None else None).otherwise(F.get(parts, F.lit(en)) if en is not None else None))
        # one of the formats at most can fit: one that fails costs an exception a line
        dated = lambda day: F.when(F.contains(day, F.lit("/")), F.try_to_timestamp(day, F.lit("dd/MM/yyyy"))).otherwise(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("date")
        return F.struct(
            layout.alias("layout"), at(0, None, None).alias("card_name"), once(at(1, 0, 3), dated).alias("date"), at(2, 1, 0).alias("description"),
            at(3, 2, 1).try_cast(MONEY).alias("signed"), at(4, 3, 2).alias("category"), F.upper(at(5, None, 4)).alias("given"),
        )

    kind_of = lambda title: F.when(F.startswith(title, F.lit("card,")), "full").when(F.startswith(title, F.lit("data,")) | F.startswith(title, F.lit("date,desc")), "pt").when(F.startswith(title, F.lit("description,")), "en").otherwise("unknown")
    cut = F.struct(once(F.lower(F.regexp_replace("first", r"\s", "")), kind_of).alias("layout"), F.split("line", ",").alias("parts"))
    # inline, not columns: a filter on a column is pushed below it, and would compute each part again for each of its uses
    out = lines.select("doc_id", "line_no", "line", F.inline(F.array(once(cut, read))))
    good = (F.col("layout") != "unknown") & F.col("date").isNotNull() & F.col("signed").isNotNull()
    kind = F.coalesce(F.nullif(F.col("given"), F.lit("")), F.when(F.col("signed") < 0, "INCOME").otherwise("EXPENSE"))
    rows = out.where(good).select("doc_id", "line_no", "layout", "card_name", "date", "description", F.abs("signed").cast(MONEY).alias("amount"), "category", kind.alias("type"))
    return rows, out.where(~good).select("doc_id", "line_no", "line")


_AMOUNT = r"-?\d{1,3}(?:\.\d{3})*,\d{2}|-?\d+,\d{2}"


def _period_end() -> Column:
    end = F.regexp_extract("text", r"(?is)(?:per[ií]odo|at[eé])\D*(?:\d{2}/\d{2}/\d{4}\s*(?:a|at[eé])\s*)?(\d{2}/\d{2}/\d{4})", 1)
    return F.try_to_timestamp(end, F.lit("dd/MM/yyyy")).cast("date")


def statement_header(docs: DataFrame) -> DataFrame:
    """Period end, opening, closing and limits of each statement text; 0 where an amount is missing."""
    after = lambda label: parse_brazilian(F.nullif(F.regexp_extract("text", rf"(?is)(?:{label})[^\d\n-]*({_AMOUNT})", 1), F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY)
    return docs.select("doc_id", _period_end().alias("statement_date"), after("saldo anterior").alias("opening_text"), after("saldo final").alias("closing_text"), zero(after("limite total")).alias("credit_limit"), zero(after("limite dispon[ií]vel")).alias("available_limit"))


def parse_statement_text(docs: DataFrame) -> DataFrame:
    """Rows of the section after the line 'lançamentos' (the whole text without one): a date, a description,
    an amount with D or C (or a sign), and a balance if there is one. Lines with 'saldo' are BALANCE rows of amount 0.
    A date without a year takes the statement's. Text on one line is split before each date."""
    cut = F.regexp_replace("text", r"(?is)^.*?lan[cç]amentos[^\n]*\n", "")
    cut = F.regexp_replace(cut, r"(?is)\n\s*lan[cç]amentos futuros.*$", "")
    rows = docs.select("doc_id", _period_end().alias("statement_date"), F.posexplode(F.split(cut, r"\r?\n|(?<=[0-9DC]) +(?=\d{2}/\d{2}(?:/\d{4})? )")).alias("line_no", "line"))
    shape = rf"^\s*(\d{{2}}/\d{{2}}(?:/\d{{4}})?)\s+(.+?)\s+({_AMOUNT})\s*([DC]?)(?:\s+({_AMOUNT}))?\s*$"
    get = lambda i: F.regexp_extract("line", shape, i)
    day = get(1)
    full = F.when(F.length(day) == 5, F.concat(day, F.lit("/"), F.year("statement_date").cast("string"))).otherwise(day)
    value = parse_brazilian(get(3))
    kind = F.when(F.lower(get(2)).contains("saldo"), "BALANCE").when((get(4) == "D") | (value < 0), "DEBIT").when(get(4) == "C", "CREDIT").otherwise("DEBIT")
    parsed = rows.where(F.col("line").rlike(shape)).select("doc_id", "line_no", F.try_to_timestamp(full, F.lit("dd/MM/yyyy")).cast("date").alias("date"), get(2).alias("description"), value.alias("value"), parse_brazilian(F.nullif(get(5), F.lit(""))).alias("given"), kind.alias("type"))
    amount = F.when(F.col("type") == "BALANCE", 0).when(F.col("type") == "DEBIT", -F.abs("value")).otherwise(F.abs("value")).cast(MONEY)
    balance = F.when(F.col("type") == "BALANCE", F.col("value")).otherwise(F.col("given"))
    return parsed.where("date is not null").select("doc_id", "line_no", "date", "description", amount.alias("amount"), balance.alias("balance"), "type")


def fill_balances(rows: DataFrame) -> DataFrame:
    """Missing balances: the last known one plus the amounts since; before any, the opening, which is the
    first row's balance less its amount if it has one, else 0. In order of date and line."""
    order = Window.partitionBy("doc_id").orderBy("date", "line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seg = rows.withColumn("segment", F.count("balance").over(upto))
    inside = Window.partitionBy("doc_id", "segment").orderBy("date", "line_no")
    known = F.first("balance").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    since = F.sum("amount").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    base = F.when(F.col("segment") == 0, since).otherwise(known + since - F.first("amount").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return seg.withColumn("filled", F.coalesce("balance", base).cast(MONEY)).drop("segment")


#: Layouts of invoice text as a table: a row per shape, with the groups of day, description, amount and instalments.
LAYOUTS = [
    ("worded", 0, "(?i)nubank|fatura de", r"^(\d{2} [A-Z]{3}) (.+?) (-?R\$ ?[\d.]+,\d{2})$", 1, 2, 3, 0, 0),
    ("slashed", 1, "(?i)mercado|vencimento", r"^(\d{2}/\d{2}) (.+?)(?: parcela (\d+) de (\d+))? R\$ ?(-?[\d.]+,\d{2})$", 1, 2, 5, 3, 4),
]
LAYOUT_SCHEMA = "layout string, ordinal int, marker string, shape string, g_day int, g_desc int, g_amount int, g_no int, g_of int"


def due_date(text: Column) -> Column:
    """The date after a due-date label: numeric, then with a month's name, then the first eight digits."""
    label = r"(?is)(?:vencimento|vence em|data de vencimento)"
    numeric = F.regexp_extract(text, label + r"\D{0,20}(\d{2}/\d{2}/\d{4})", 1)
    words = F.regexp_extract(text, label + r"\D{0,20}(\d{1,2} [A-Za-z]{3}) \d{4}", 1)
    year = F.regexp_extract(text, label + r"\D{0,20}\d{1,2} [A-Za-z]{3} (\d{4})", 1)
    digits = F.regexp_extract(text, label + r"\D*(\d{8})", 1)
    return F.coalesce(
        F.try_to_timestamp(numeric, F.lit("dd/MM/yyyy")).cast("date"),
        parse_date(F.nullif(words, F.lit("")), F.try_to_timestamp(F.concat(year, F.lit("-12-31")), F.lit("yyyy-MM-dd")).cast("date")),
        F.try_to_timestamp(digits, F.lit("ddMMyyyy")).cast("date"),
    )


def parse_invoice_text(docs: DataFrame, layouts: DataFrame) -> DataFrame:
    """Rows of every applicable layout (its marker occurs): purchase year is the due year, one less where
    the month is later; a day that this year lacks has a null date. Payments and refunds (a minus, or 'pagamento') are
    income. Layouts are chosen once a document, and its lines are split in place: nothing is shuffled."""
    text = F.regexp_replace("text", "^\\ufeff", "")
    chosen = docs.select("doc_id", "text", due_date(F.col("text")).alias("due_date")).join(small(layouts), F.expr("text rlike marker"))
    lines = chosen.select("doc_id", "due_date", *layouts.columns, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    hits = lines.where("line rlike shape")
    get = lambda g: F.expr(f"case when {g} > 0 then regexp_extract(line, shape, {g}) end")
    def dated(p):
        (day, month_of), full, due = day_and_month(F.trim(p)), parse_date(p, F.col("due_date")), F.col("due_date")
        parts = F.struct(F.coalesce(day.cast("int"), F.dayofmonth(full)).alias("day"), F.coalesce(month_of.cast("int"), F.month(full)).alias("month"))
        return once(parts, lambda d: try_date(F.year(due) - F.when(d["month"] > F.month(due), 1).otherwise(0), d["month"], d["day"]))

    day = once(get("g_day"), dated)
    value = parse_loose(get("g_amount"))
    kind = F.when((value < 0) | F.lower(get("g_desc")).contains("pagamento"), "INCOME").otherwise("EXPENSE")
    number = lambda g: F.nullif(get(g), F.lit("")).try_cast("int")
    return hits.select("doc_id", "layout", "ordinal", "line_no", day.alias("date"), F.trim(get("g_desc")).alias("description"), F.abs(value).cast(MONEY).alias("amount"), kind.alias("type"), number("g_no").alias("installment_number"), number("g_of").alias("installment_total"), "due_date")


def select_layout(docs: DataFrame, parsed: DataFrame, layouts: DataFrame) -> DataFrame:
    """(doc_id, layout, score): applicable 1,000,000, due date 100,000, rows 10,000 and 20 each up to 5,000
    more; rows count only if applicable or dated. The best by score, then ordinal; none at 0 or less."""
    each = small(layouts.select("layout", "ordinal", "marker").distinct())
    # markers are tried before anything is shuffled, so that no text is
    base = docs.select("doc_id", F.col("text").alias("whole"), due_date(F.col("text")).isNotNull().alias("dated")).crossJoin(each).select("doc_id", "layout", "ordinal", "dated", F.expr("whole rlike marker").alias("fits"))
    counts = parsed.groupBy("doc_id", "layout").agg(F.count("*").alias("n"))
    rows = F.when((F.col("fits") | F.col("dated")) & (F.coalesce("n", F.lit(0)) > 0), 10_000 + F.least(F.lit(5_000), 20 * F.col("n"))).otherwise(0)
    score = F.when(F.col("fits"), 1_000_000).otherwise(0) + F.when(F.col("dated"), 100_000).otherwise(0) + rows
    scored = base.join(grows(counts), ["doc_id", "layout"], "left").select("doc_id", "layout", "ordinal", score.alias("score"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ordinal"))
    return scored.withColumn("r", best).where("r = 1 and score > 0").select("doc_id", "layout", F.col("score").cast("bigint").alias("score"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("created_at"))


def dedup_uploads(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each file with the newest job of its person and digest to reuse: not if it failed, or if password or due date differ."""
    newest = Window.partitionBy("person_id", "sha256").orderBy(F.desc("created_at"), F.desc("job_id"))
    last = jobs.withColumn("r", F.row_number().over(newest)).where("r = 1").select("person_id", "sha256", "job_id", "status", F.col("password").alias("job_password"), F.col("due_date").alias("job_due"))
    joined = files.join(last, ["person_id", "sha256"], "left")
    reuse = (F.col("status") != "FAILED") & F.col("password").eqNullSafe(F.col("job_password")) & F.col("due_date").eqNullSafe(F.col("job_due"))
    return joined.select("person_id", "sha256", "file_id", F.when(reuse, F.col("job_id")).alias("reused_job"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a row, by type and period; writing a period again replaces it."""
    reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("report_type", "period_start").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Score history by calculation date; a rerun replaces its own date."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calculation_date").parquet(path)
