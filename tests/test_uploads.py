"""Cards, due dates and totals of upload batches, against replays row by row."""

import random
from datetime import date
from decimal import Decimal as M

import pytest

from tallyspark.operators import composites, ingesting, invoicing


def replay(rows, cards):
    """One row after the other, each against all cards so far; within an upload by the key seen first."""
    known, cache, out = sorted(cards), {}, {}
    for row in sorted(rows, key=lambda r: (r["upload"], r["place"], r["row_id"])):
        b, n = (row["brand"] or row["name"]).lower(), (row["name"] or row["brand"]).lower()
        key = (row["owner_id"], row["upload"], b, row["last_four"] or n)
        if key in cache:
            out[row["row_id"]] = (*cache[key], "upload")
            continue
        mine = [c for c in known if c[1] == row["owner_id"] and c[3].lower() == b]
        by_digits = [c for c in mine if row["last_four"] and c[4] == row["last_four"]]
        by_name = [c for c in mine if c[2].lower() == n]
        hit = (by_digits or by_name or [None])[0]
        how = "digits" if by_digits else "name" if by_name else "new"
        if not hit:
            hit = (10**9 + len(known), row["owner_id"], row["name"] or row["brand"], row["brand"] or row["name"], row["last_four"], row["row_id"])
            known.append(hit)
        cache[key] = (hit[0], None) if len(hit) == 5 else (None, hit[5])
        out[row["row_id"]] = (*cache[key], how)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cards_of_random_batches(spark, seed):
    rng = random.Random(seed)
    cards = [(i, rng.randrange(3), rng.choice(["Gold", "black", "x"]), rng.choice(["Visa", "ELO"]), rng.choice(["1111", "2222", None])) for i in range(5)]
    rows = [
        {"row_id": i, "owner_id": rng.randrange(4), "upload": rng.randrange(12), "place": rng.randrange(6), "name": rng.choice(["gold", "Black", "n1", "N2", "n3", None]), "brand": rng.choice(["VISA", "visa", "elo"]), "last_four": rng.choice(["1111", "2222", "3333", "4444", "5555", None])}
        for i in range(250)
    ]
    schema = "row_id bigint, owner_id bigint, upload bigint, place bigint, name string, brand string, last_four string"
    given = spark.createDataFrame(cards, "card_id bigint, owner_id bigint, name string, brand string, last_four string")
    resolved = invoicing.resolve_cards(spark.createDataFrame(rows, schema), given)
    got = {r.row_id: (r.card_id, r.made_by, r.matched_by) for r in resolved.collect()}
    want = replay(rows, cards)
    assert got == want and {"digits", "name", "new", "upload"} == {w[2] for w in want.values()}
    made = invoicing.new_cards(spark.createDataFrame(rows, schema), resolved).collect()
    assert {r.made_by for r in made} == {i for i, w in want.items() if w[2] == "new"}
    assert {(r.limit_amount, r.closing_day, r.due_day) for r in made} == {(M("10000.00"), 5, 15)}


def test_a_chain_of_cards_takes_a_round_for_every_second(spark):
    """Digits and names that wait for each other: the longest chain that rows can make."""
    rows = [(i, 1, i, 0, f"n{(i + 1) // 2}", "visa", f"d{i // 2}") for i in range(9)]
    schema = "row_id bigint, owner_id bigint, upload bigint, place bigint, name string, brand string, last_four string"
    none = spark.createDataFrame([], "card_id bigint, owner_id bigint, name string, brand string, last_four string")
    got = {r.row_id: (r.card_id, r.made_by, r.matched_by) for r in invoicing.resolve_cards(spark.createDataFrame(rows, schema), none).collect()}
    assert got == replay([dict(zip(("row_id", "owner_id", "upload", "place", "name", "brand", "last_four"), r)) for r in rows], [])


def test_due_dates_and_digits(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(date(2024, 1, 31), 15), (date(2024, 1, 31), 31), (date(2023, 12, 5), None), (date(2024, 1, 1), 28)], "d date, day int")
    assert [r[0] for r in d.select(composites.estimated_due(F.col("d"), F.col("day"))).collect()] == [date(2024, 2, 15), date(2024, 2, 10), date(2024, 1, 10), date(2024, 2, 28)]
    names = spark.createDataFrame([("Visa **** 1234", "f"), ("MASTER final 4321 mes 06", "f"), ("card", "elo-9876.csv"), ("none", "")], "n string, f string")
    got = [tuple(r[0]) for r in names.select(ingesting.card_identity(F.col("n"), F.col("f"))).collect()]
    assert got == [("visa", "1234"), ("mastercard", "4321"), ("elo", "9876"), (None, None)]


def test_totals_of_uploads_and_invoices(spark):
    """A stated total counts if it is positive and the upload is of one invoice; later uploads add to it."""
    schema = "doc_id bigint, card_key string, year int, month int, amount decimal(19,2), due_date date"
    day = date(2024, 5, 10)
    lines = spark.createDataFrame([(1, "a", 2024, 5, M(10), day), (2, "a", 2024, 5, M(7), day), (3, "a", 2024, 5, M(5), day), (3, "b", 2024, 5, M(4), day), (4, "c", 2024, 5, M(2), day)], schema)
    stated = spark.createDataFrame([(1, M(0)), (2, M(100)), (3, M(50)), (4, None)], "doc_id bigint, stated decimal(19,2)")
    old = spark.createDataFrame([("a", 2024, 5, M(1), date(2024, 5, 1)), ("z", 2024, 5, M(3), day)], "card_key string, year int, month int, total_amount decimal(19,2), due_date date")
    got = {r.card_key: (r.total, r.due_date, r.action) for r in composites.invoice_totals(lines, stated, old).collect()}
    assert got == {"a": (M("105.00"), date(2024, 5, 1), "update"), "b": (M("4.00"), day, "insert"), "c": (M("2.00"), day, "insert"), "z": (M("3.00"), day, "keep")}
    rows = spark.createDataFrame([(1, "v", day, day, M(10), "EXPENSE", M(0)), (2, "v", day, day, M(10), "EXPENSE", M(15)), (3, "v", day, day, M(10), "EXPENSE", M(15)), (3, "w", day, day, M(4), "INCOME", M(15))], "doc_id bigint, card_name string, date date, due_date date, amount decimal(19,2), type string, document_total decimal(19,2)")
    from pyspark.sql import functions as F

    assert {r.doc_id: (r.total, r.summed) for r in ingesting.upload_summary(rows, F.lit(True)).collect()} == {1: (M("10.00"), M("10.00")), 2: (M("15.00"), M("10.00")), 3: (M("6.00"), M("6.00"))}


def test_only_the_parts_asked_for_are_computed(spark, monkeypatch):
    """Invoices classify nothing, and rows of an upload are derived once, however many results read them."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "string").asNondeterministic()
    day = date(2024, 5, 10)
    rows = [(d, n, f"text {n}", M(10), "EXPENSE", day, day, 7, "Visa 1111", M(30), None) for d in (1, 2) for n in (1, 2, 3)]
    parsed = spark.createDataFrame(rows, "doc_id bigint, line_no int, description string, amount decimal(19,2), type string, date date, due_date date, person_id bigint, card_name string, document_total decimal(19,2), category string")
    empty = lambda schema: spark.createDataFrame([], schema)
    tables = [empty("user_id bigint, pattern string, category string, priority int, created_at date"), empty("user_id bigint, transaction_id string, chosen_category string, created_at date"), empty("tx_id string, description string"), empty("ordinal int, pattern string, category string, confidence double"), empty("category string, keyword string, weight double")]
    old = empty("card_id bigint, year int, month int, total_amount decimal(19,2), due_date date")
    cards = empty("card_id bigint, owner_id bigint, name string, brand string, last_four string")
    with monkeypatch.context() as m:
        m.setattr(composites.classifying, "classify", lambda *a: pytest.fail("classified for nothing"))
        got = composites.ingest(parsed.withColumn("description", seen("description")), *tables, old, cards, parts=["invoices", "uploads"])
        assert set(got) == {"invoices", "uploads"}
        assert [(r.total, r.action) for r in got["invoices"].collect()] == [(M("30.00"), "insert")]
        assert {r.doc_id: (r.n, r.total, r.summed) for r in got["uploads"].collect()} == {1: (3, M("30.00"), M("30.00")), 2: (3, M("30.00"), M("30.00"))}
    assert calls.value == len(rows)
    every = composites.ingest(parsed, *tables, old, cards)
    assert set(every) == {"transactions", "cards", "new_cards", "installments", "invoices", "uploads"}
    assert {(r.category, r.category_by, r.confidence) for r in every["transactions"].collect()} == {("Outros", "default", 0.5)}


def test_refunds_of_large_groups_and_random_ones(spark):
    """Against a walk line by line; a group of 40,000 lines took an array of that size, rebuilt at each of them."""
    rng = random.Random(5)
    rows = [(g, n, date(2024, 1, 1 + g % 2), M(rng.randrange(1, 3)), "EXPENSE", rng.choice(["Tarifa", "Estorno tarifa", "shop"])) for g in range(30) for n in range(40)]
    rows += [(99, n, date(2024, 1, 1), M(1), "EXPENSE", "Estorno anuidade" if n < 20_000 else "anuidade") for n in range(40_000)]
    waiting, gone = {}, set()
    for doc, line, day, amount, _, text in rows:
        queue = waiting.setdefault((doc, day, amount), [])
        if "Estorno" in text:
            queue.append(line)
        elif text != "shop" and queue:
            gone |= {(doc, queue.pop(0)), (doc, line)}
    df = spark.createDataFrame(rows, "doc_id int, line_no int, date date, amount decimal(19,2), type string, description string")
    got = {(r.doc_id, r.line_no) for r in ingesting.cancel_refunds(df).collect()}
    assert got == {r[:2] for r in rows} - gone


def test_rows_of_a_batch_are_derived_once(spark):
    """Both joins of a batch's rows read what is written of them; they derived it each."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "string").asNondeterministic()
    rows = spark.createDataFrame([(i, 1, i % 2, i, "gold", "visa", "1111") for i in range(6)], "row_id bigint, owner_id bigint, upload bigint, place bigint, name string, brand string, last_four string")
    none = spark.createDataFrame([], "card_id bigint, owner_id bigint, name string, brand string, last_four string")
    got = invoicing.resolve_cards(rows.select("row_id", "owner_id", "upload", "place", "name", "brand", seen("last_four").alias("last_four")), none).collect()
    assert {(r.row_id, r.made_by, r.matched_by) for r in got} == {(0, 0, "new"), (1, 0, "digits"), *((i, 0, "upload") for i in range(2, 6))}
    assert calls.value == 6


def test_cards_of_an_ingest_are_those_of_resolved_rows(spark):
    """Lines carry the first line of their card in its upload and meet cards in one join; entries are transactions without categories."""
    rng = random.Random(8)
    names = ["Visa 1111", "visa gold 1111", "Visa gold", "elo", "Elo 2222", "own card", None]
    lines = [(d, n, f"text {rng.randrange(3)}", M(rng.randrange(3)), "EXPENSE", date(2024, 5, 10), None, d % 3, rng.choice(names), M(30)) for d in range(12) for n in (1, 2, 2, 3)]
    parsed = spark.createDataFrame(lines, "doc_id bigint, line_no int, description string, amount decimal(19,2), type string, date date, due_date date, person_id bigint, card_name string, document_total decimal(19,2)")
    empty = lambda schema: spark.createDataFrame([], schema)
    tables = [empty("user_id bigint, pattern string, category string, priority int, created_at date"), empty("user_id bigint, transaction_id string, chosen_category string, created_at date"), empty("tx_id string, description string"), empty("ordinal int, pattern string, category string, confidence double"), empty("category string, keyword string, weight double")]
    cards = spark.createDataFrame([(5, 1, "Gold", "VISA", "1111", 20), (6, 1, "x", "visa", "1111", 3), (7, 2, "own card", "own card", None, None)], "card_id bigint, owner_id bigint, name string, brand string, last_four string, due_day int")
    old = empty("card_id bigint, year int, month int, total_amount decimal(19,2), due_date date")
    got = composites.ingest(parsed, *tables, old, cards, parts=["entries", "cards", "new_cards"])
    key = lambda owner, brand, digits, name: "|".join(["new", str(owner), brand, digits or "", name])
    brand = lambda n: next((b for b in ("visa", "elo") if b in (n or "").lower()), None)
    digits = lambda n: n[-4:] if n and n[-1].isdigit() else None
    named, of = {}, {}
    for d, n, text, amount, _, _, _, who, name, _ in lines:
        if amount:
            shown = name or "Card"
            row = (f"{d}|{who}|{brand(name) or shown}|{digits(name) or ''}|{shown}", who, d, shown, brand(name) or shown, digits(name))
            named[row] = min(n, named.get(row, 9))
            of["-".join(str(x) for x in (d, n, text, f"{amount:.2f}", *([name] if name else [])))] = row[0]
    rows = spark.createDataFrame([(r[0], r[1], r[2], n, *r[3:]) for r, n in named.items()], "row_id string, owner_id bigint, upload bigint, place int, name string, brand string, last_four string")
    who = {r[0]: r for r in named}
    want = {r.row_id: (str(r.card_id) if r.card_id else key(who[r.made_by][1], who[r.made_by][4], who[r.made_by][5], who[r.made_by][3]), r.matched_by) for r in invoicing.resolve_cards(rows, cards).collect()}
    entries = got["entries"].collect()
    assert "category" not in got["entries"].columns and {r.matched_by for r in entries} == {"upload", "digits", "name", "new"}
    assert {r.tx_id: (r.card_key, r.matched_by) for r in entries} == {t: want[row] for t, row in of.items()}
    assert {r.card_key for r in got["new_cards"].collect()} == {k for k, how in want.values() if how == "new"}
    day = {k: 20 if k == "5" else 10 if k == "7" else 15 for k, _ in want.values()}
    assert all(r.transaction_date == date(2024, 6, day[r.card_key]) for r in entries)
    assert {(r.card_key, r.matched_by) for r in got["cards"].collect()} == set(want.values())


def test_refunds_of_tied_rows_do_not_hang_on_how_rows_arrive(spark, tmp_path):
    """A refund and a fee that agree in all that the query's SQL orders by, with no refund waiting: what was kept hung on which was read first."""
    from pyspark.sql import functions as F

    from tallyspark.plans.registry import QUERIES

    day = date(2024, 1, 1)
    spark.createDataFrame([(0, 1, M(9), day, "F", "1-URGENT")], "o_orderkey bigint, o_custkey bigint, o_totalprice decimal(19,2), o_orderdate date, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/a/orders.parquet")
    spark.createDataFrame([(1, "bolt", "b")], "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/a/part.parquet")
    lines = [(0, 1, 1, 1, 50.0, 7.0, "R"), (0, 1, 1, 1, 50.0, 7.0, "N"), (0, 1, 1, 2, 5.0, 7.0, "N")]
    kept = []
    for name, order in (("refund", (0, 1, 2)), ("fee", (1, 0, 2))):
        rows = spark.createDataFrame([lines[i] for i in order], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
        at = tmp_path / name
        rows.withColumn("l_shipdate", F.lit(day)).coalesce(1).write.parquet(f"{at}/lineitem.parquet")
        for t in ("orders", "part"):
            spark.read.parquet(f"{tmp_path}/a/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
        kept.append([(r.doc_id, r.line_no, r.description) for r in QUERIES["so7_cancel_refunds"](spark, str(at)).collect()])
    assert kept == [[(0, 1, "Tarifa")]] * 2


def test_tables_that_grow_are_not_broadcast(spark, tmp_path):
    """Cards that a batch made, and uploads, were broadcast through the driver as long as the compressed files looked small."""
    import contextlib
    import io

    from pyspark.sql import functions as F

    from tallyspark.functions import sizes

    def plan(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        return out.getvalue()

    rows = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("owner_id"), F.col("id").alias("upload"), F.lit(0).alias("place"), F.lit("gold").alias("name"), F.lit("visa").alias("brand"), F.lit("1111").alias("last_four"))
    none = spark.createDataFrame([], "card_id bigint, owner_id bigint, name string, brand string, last_four string")
    resolved = invoicing.resolve_cards(rows, none)
    assert "Broadcast" not in plan(resolved) and {r.made_by for r in resolved.collect()} == {0, 1, 2}
    docs = spark.createDataFrame([(1, "mercado\nvencimento 10/05/2024\n03/05 shop R$ 5,00"), (2, "nothing")], "doc_id bigint, text string")
    from tallyspark.sources import texts

    layouts = spark.createDataFrame(texts.LAYOUTS, texts.LAYOUT_SCHEMA)
    parsed = texts.parse_invoice_text(docs, layouts)
    parsed.write.parquet(f"{tmp_path}/rows")
    counted = texts.select_layout(docs, spark.read.parquet(f"{tmp_path}/rows"), layouts)
    assert "SortMergeJoin" in plan(counted) and [(r.doc_id, r.layout) for r in counted.collect()] == [(1, "slashed")]
    few = spark.range(3)
    assert "Broadcast" in plan(few.join(few, "id")) and "Broadcast" not in plan(few.join(sizes.grows(few), "id"))


def test_rows_of_a_batch_are_written_and_shuffled_once(spark, monkeypatch):
    """Rows were written, and again with their keys, nearly all of them; descriptions were shuffled twice."""
    import contextlib
    import io

    written, plain = [], invoicing.clustered
    monkeypatch.setattr(invoicing, "clustered", lambda df, name, *keys, **how: written.append((name, df)) or plain(df, name, *keys, **how))
    rows = spark.range(40).selectExpr("id as row_id", "id % 3 as owner_id", "id div 4 as upload", "id % 4 as place", "concat('n', id % 5) as name", "if(id % 2 = 0, 'visa', 'elo') as brand", "cast(id % 7 as string) as last_four")
    none = spark.createDataFrame([], "card_id bigint, owner_id bigint, name string, brand string, last_four string")
    got = invoicing.resolve_cards(rows, none)
    assert [name for name, _ in written].count("card-rows") == 1 and {name for name, _ in written} == {"card-rows", "cards-left"}
    for name, df in written:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        assert name != "card-rows" or out.getvalue().count("Exchange") == 1
    want = replay([r.asDict() for r in rows.collect()], [])
    assert {r.row_id: (r.card_id, r.made_by, r.matched_by) for r in got.collect()} == want


def test_texts_and_lines_of_uploads_are_shuffled_once(spark, monkeypatch):
    """Texts were shuffled again for their scores, and their lines for layout, total, score and card."""
    import contextlib
    import io

    from tallyspark.plans.registry import QUERIES

    shuffled, saved, clustered = {}, composites.saved, composites.clustered

    def seen(df, name):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        shuffled[name] = [line for line in out.getvalue().splitlines() if "Exchange" in line and "Broadcast" not in line]
        return df

    monkeypatch.setattr(composites, "saved", lambda df, name: saved(seen(df, name), name))
    monkeypatch.setattr(composites, "clustered", lambda df, name, *keys, **how: clustered(seen(df, name), name, *keys, **how))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert QUERIES["up1_from_texts"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # lines in place; scores: their totals only; rows: totals and scores of their documents, and the layouts' few patterns
    assert [len(shuffled[name]) for name in ("upload-rows", "upload-totals", "upload-scores")] == [0, 0, 1]
    assert not any("line_no" in line or "card" in line for line in shuffled["ingest-rows"]) and len(shuffled["ingest-rows"]) <= 4
