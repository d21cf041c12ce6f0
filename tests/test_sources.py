"""Files read in splits, and tables over JDBC."""

import random

from pyspark.sql import functions as F

from tallyspark.operators import summaries
from tallyspark.sources import texts


def test_large_exports_are_many_tasks(spark, tmp_path):
    """Line numbers, headers, blank lines and byte order marks of files in many splits are as those of whole texts."""
    rng = random.Random(5)
    for k in range(3):
        head = ["\n﻿" if k == 1 else "﻿" * (k == 0), ["data,descricao,valor,categoria", "description,amount,category,date,type", "card,date,description,amount,category,type"][k]]
        body = [rng.choice(["", "  ", "broken", "01/02/2024,Café,-12.50,Food", "x,3.10,Food,2024-01-02,", "v 1,2024-03-04,y,7.00,z,income"]) for _ in range(900)]
        (tmp_path / f"f{k}.csv").write_text("".join(head) + "\n" + ("\r\n" if k == 2 else "\n").join(body), encoding="utf-8")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    want = [sorted(map(str, x.collect())) for x in texts.parse_exports(whole)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in before:
        spark.conf.set(c, "2000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = [sorted(map(str, x.collect())) for x in texts.read_csv_exports(spark, str(tmp_path))]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert [[x for x in g if x not in set(w)][:3] for g, w in zip(got, want)] == [[], []]
    assert got == want and len(want[0]) > 300 and len(want[1]) > 300


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "nubank vencimento 01/02/2024\n")], "doc_id bigint, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(texts.parse_statement_text(docs)) and "Exchange" not in plan(texts.parse_exports(docs)[0])
    layouts = spark.createDataFrame(texts.LAYOUTS, texts.LAYOUT_SCHEMA)
    chosen = plan(texts.select_layout(docs, texts.parse_invoice_text(docs, layouts), layouts))
    # markers are tried in the projection of the join with the layouts, below any other join
    assert "whole" not in chosen.split("LeftOuter")[0].split("BroadcastNestedLoopJoin")[0] or "fits" in chosen


def test_tables_over_jdbc(spark, tmp_path):
    """Skewed ids and nulls: each row in one partition, about as many in each, filters with the database."""
    url = f"jdbc:derby:memory:t{random.Random().randrange(10**9)};create=true"
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else i if i % 7 else 10**9 + i, f"n{i % 5}") for i in range(2000)]
    spark.createDataFrame(rows, "id bigint, name string").write.option("createTableColumnTypes", "name VARCHAR(10)").jdbc(url, "t")
    df = texts.read_table(spark, "t", url=url, partition_column="ID", partitions=8)
    assert sorted(map(str, df.collect())) == sorted(f"Row(id={a}, name='{b}')" for a, b in rows)
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    share = sum(a == 7 for a, _ in rows)
    assert 6 <= df.rdd.getNumPartitions() <= 9 and sorted(r["count"] for r in sizes)[-2] < 2 * 2000 / 8 and max(r["count"] for r in sizes) <= share
    kept = df.where("name = 'n1' and id > 10").select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,n1)" in plan and "GreaterThan(id,10)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert kept.count() == sum(b == "n1" and a is not None and a > 10 for a, b in rows)
    assert texts.read_table(spark, "t", url=url).count() == 2000
    spark.createDataFrame([(None, "x"), (None, "y")], "id bigint, name string").write.jdbc(url, "empty_ids")
    assert texts.read_table(spark, "empty_ids", url=url, partition_column="id").count() == 2
    days = spark.range(100).select(F.expr("date'2024-01-01' + cast(id as int)").alias("day"))
    days.write.jdbc(url, "days")
    assert texts.read_table(spark, "days", url=url, partition_column="day", partitions=4).groupBy(F.spark_partition_id()).count().where("count > 40").count() == 0


def test_pages_of_a_busy_account(spark):
    """Pages by day cells are those of one sort; a page in the middle of a day, days without dates, pages beyond the last."""
    rng = random.Random(6)
    rows = [(f"t{i:04d}", 1 if i % 5 else 2, None if i % 40 == 0 else f"2024-01-{rng.choice([1, 1, 1, 2, 9]):02d}", None if i % 11 else "2024-02-01") for i in range(400)]
    tx = spark.createDataFrame(rows, "tx_id string, person_id bigint, d string, x string").selectExpr("tx_id", "person_id", "cast(d as date) transaction_date", "cast(x as date) deleted_at")
    for number, size in ((0, 7), (3, 25), (13, 25), (100, 25)):
        want = set()
        for p in (1, 2):
            mine = sorted((r for r in rows if r[1] == p and r[3] is None), key=lambda r: r[0])
            mine.sort(key=lambda r: r[2] or "", reverse=True)
            want |= {(p, r[0], k + 1, -(-len(mine) // size)) for k, r in enumerate(mine) if number * size <= k < number * size + size}
        assert {(r.person_id, r.tx_id, r["rank"], r.pages) for r in summaries.page(tx, number, size).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_of_odd_shapes_are_cut_not_tried(spark):
    """Each shape is read by its own numbers; the formats that don't fit were tried, several times a row."""
    from pyspark.sql import functions as F

    from tallyspark.functions.dates import parse_date

    want = {
        "2024-02-29": "2024-02-29", "2023-02-29": None, "0000-01-01": None, "2024-13-01": None, "2024-00-10": None, "31/04/2024": None, "30/04/2024": "2024-04-30", "05/06/07": "2007-06-05", "29/02/99": None,
        "29/02": None, "28/02": "2023-02-28", "1/3": "2023-03-01", "2/3": "2022-03-02", "29 FEV": None, "5 fev.": "2023-02-05", "31 DEZ": "2022-12-31", "99/99": None, "5 abc": None, "": None, "2024-1-1": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", parse_date(F.col("s"), F.lit("2023-02-01").cast("date")).cast("string").alias("d"))
    assert {r.s: r.d for r in df.collect()} == want
    assert "timestamp" not in _plan(df)


def test_lines_of_exports_are_split_once(spark):
    """A filter on what is parsed was pushed below it, and split a line again for each use of a part."""
    text = "data,descricao,valor,categoria\n2024-01-02,a,3.50,x\n03/01/2024,b,-1,y\nno,row\n1/2,c,3,z"
    files = spark.range(1).selectExpr("id as doc_id", f"'{text}' as text".replace("\n", "\\n"))
    rows, rejected = texts.parse_exports(files)
    assert [(str(r.date), r.description, str(r.amount), r.type) for r in rows.collect()] == [("2024-01-02", "a", "3.50", "EXPENSE"), ("2024-01-03", "b", "1.00", "INCOME")]
    assert [(r.line_no, r.line) for r in rejected.collect()] == [(3, "no,row"), (4, "1/2,c,3,z")]
    for df in (rows, rejected):
        assert _plan(df).count("split(line") == 1
