"""Small tables of our own with known results."""

from datetime import date
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, text
from tallyspark.functions.dates import parse_date
from tallyspark.functions.sizes import small
from tallyspark.operators import classifying, composites, detection, ingesting, invoicing, portfolio, summaries
from tallyspark.sources import texts
from tallyspark.streaming import audit
from tallyspark.sources.testdata import view

TX = "tx_id string, person_id bigint, description string, amount decimal(19,2), type string, category string, transaction_date date, purchase_date date, status string, deleted_at date, line_no int"


def tx(spark, *rows):
    full = []
    for i, (person, description, amount, kind, category, day) in enumerate(rows):
        full.append((f"t{i}", person, description, M(str(amount)), kind, category, date.fromisoformat(day), None, "PAID", None, i))
    return spark.createDataFrame(full, TX)


def test_summary_and_breakdown(spark):
    cube = summaries.base_cube(tx(spark, (1, "pay", 1000, "INCOME", "Job", "2024-01-05"), (1, "a", 200, "EXPENSE", "Food", "2024-01-09"), (1, "b", 50, "EXPENSE", " ", "2024-01-31")))
    s = summaries.monthly_summary(cube).first()
    assert (s.income, s.expenses, s.balance, s.savings_rate) == (M("1000.00"), M("250.00"), M("750.00"), 75)
    parts = {r.category: (r.percent, r["rank"]) for r in summaries.category_breakdown(cube).collect()}
    assert parts == {"Food": (M("80.00"), 1), "Outros": (M("20.00"), 2)}
    assert summaries.monthly_evolution(cube, "2024-01-01", 12).count() == 12


def test_zero_income_and_rounding(spark):
    cube = summaries.base_cube(tx(spark, (1, "a", "0.01", "EXPENSE", "A", "2024-01-01"), (2, "i", 200, "INCOME", "A", "2024-01-01"), (2, "a", 1, "EXPENSE", "A", "2024-01-01")))
    rates = {r.person_id: r.savings_rate for r in summaries.monthly_summary(cube).collect()}
    assert rates == {1: 0, 2: 100}  # 99.5 rounds half up


@pytest.mark.parametrize("words,found", [(("Stream.com 1", "STREAM 2", "stream br"), 1), (("pix stream", "pix stream", "pix stream"), 0)])
def test_recurring(spark, words, found):
    rows = [(1, w, "39.90", "EXPENSE", "Fun", f"2024-0{m}-0{5 + m}") for m, w in enumerate(words, 1)]
    out = detection.recurring(tx(spark, *rows), "2024-03-31").collect()
    assert len(out) == found and all(r.monthly_cost == M("39.90") for r in out)


def test_recurring_tolerance_and_days(spark):
    at = lambda p, a, d: [(p, "club fee", x, "EXPENSE", "", f"2024-0{m}-{y:02d}") for m, (x, y) in enumerate(zip(a, d), 1)]
    rows = at(1, (40, 41, 42), (5, 5, 5)) + at(2, (40, 41, "42.01"), (5, 5, 5)) + at(3, (40, 40, 40), (5, 15, 16)) + at(4, (40, 40, 40), (5, 15, 15))
    assert sorted(r.person_id for r in detection.recurring(tx(spark, *rows), "2024-03-31").collect()) == [1, 4]


@pytest.mark.parametrize("months,found", [((1, 2, 3), 1), ((3,), 0)])
def test_anomaly(spark, months, found):
    rows = [(1, "x", 110, "EXPENSE", "Food", f"2024-0{m}-10") for m in months] + [(1, "x", 250, "EXPENSE", "Food", "2024-04-10")]
    out = detection.anomalies(summaries.base_cube(tx(spark, *rows))).collect()
    assert len(out) == found and all(r.severity == "alert" for r in out)


def test_growth_needs_the_month_before(spark):
    cube = summaries.base_cube(tx(spark, (1, "x", 100, "EXPENSE", "A", "2023-12-01"), (1, "x", 150, "EXPENSE", "A", "2024-01-01"), (1, "x", 900, "EXPENSE", "A", "2024-03-01")))
    assert [(r.month, r.growth) for r in detection.monthly_growth(cube).collect()] == [(date(2024, 1, 1), M("50.00"))]


def test_trip_of_exactly_thirty_days(spark):
    rows = [(1, "hotel", 10, "EXPENSE", "T", d) for d in ("2024-01-01", "2024-01-10", "2024-01-20", "2024-01-31")] + [(1, "food", 5, "EXPENSE", "T", "2024-01-15"), (1, "food", 5, "EXPENSE", "T", "2024-02-01")]
    t = tx(spark, *rows)
    found = detection.trips(t, ["hotel"])
    r = found.first()
    assert (r.trip_start, r.trip_end, r.candidates) == (date(2024, 1, 1), date(2024, 1, 31), 4)
    assert detection.trip_expenses(t, found).count() == 5
    assert detection.trips(t, ["hotel"], days=29).count() == 0


def test_volatility_budget(spark):
    rows = [(1, "x", a, "EXPENSE", "Fun", f"2024-0{m}-01") for m, a in enumerate((100, 300, 200), 1)] + [(1, "x", a, "EXPENSE", "Rent", f"2024-0{m}-01") for m, a in enumerate((200, 210, 205), 1)]
    out = detection.volatility(summaries.base_cube(tx(spark, *rows))).collect()
    assert [(r.category, r.cv, r.budget) for r in out] == [("Fun", 0.5, M("220.00"))]


def test_critical(spark):
    t = tx(spark, (1, "x", 5000, "EXPENSE", "A", "2024-01-01"), (1, "odd casino", 10, "EXPENSE", "A", "2024-01-01"), (1, "x", 10, "EXPENSE", "Apostas", "2024-01-01")).withColumn("critical_reviewed", F.lit(True))
    reasons = [r.critical_reason for r in detection.flag_critical(t, 5000, ["apostas"], ["casino"]).orderBy("tx_id").collect()]
    assert reasons == ["HIGH_VALUE", "SUSPICIOUS_DESCRIPTION", "RISKY_CATEGORY"]
    off = detection.flag_critical(t, enabled=False).collect()
    assert not any(r.is_critical or r.critical_reviewed for r in off)


def test_score(spark):
    persons = spark.createDataFrame([(1,), (2,)], "person_id bigint")
    cards = spark.createDataFrame([(10, 1, M("10000"))], "card_id bigint, owner_id bigint, limit_amount decimal(19,2)")
    invoices = spark.createDataFrame([(1, 10, 1, 2024, date(2024, 1, 10), M("7000"), "PAID", date(2024, 1, 10), None)], "invoice_id bigint, card_id bigint, month int, year int, due_date date, total_amount decimal(19,2), status string, paid_date date, deleted_at date")
    out = {r.person_id: r for r in composites.health_scores(persons, tx(spark, (1, "x", 10, "EXPENSE", "Food", "2024-01-20")), cards, invoices, "2024-01-31").collect()}
    assert (out[1].utilization, out[1].on_time, out[1].diversity) == (70, 100, 20)
    assert (out[2].utilization, out[2].on_time, out[2].consistency, out[2].history) == (100, 100, 100, 20)


def test_budget(spark):
    b = spark.createDataFrame([(1, *map(M, ("10000", "3000", "1000", "1500", "2500", "500", "0", "0")))], "owner_id bigint, income decimal(19,2), essential_fixed_cost decimal(19,2), necessary_fixed_cost decimal(19,2), variable_fixed_cost decimal(19,2), investment decimal(19,2), planned_purchase decimal(19,2), debt decimal(19,2), protection decimal(19,2)")
    r = portfolio.budget_health(b).first()
    assert (r.total, r.balance, r.needs_percent, r.wants_percent, r.savings_percent, r.healthy) == (M("8500.00"), M("1500.00"), M("40.00"), M("20.00"), M("25.00"), True)


def test_debt_goal(spark):
    flow = tx(spark, *[(1, "x", a, k, "A", f"2024-0{m}-05") for m in (1, 2, 3) for a, k in ((6000, "INCOME"), (4000, "EXPENSE"))])
    r = composites.debt_payoff(flow, spark.createDataFrame([(1, M("800.00"))], "owner_id bigint, outstanding decimal(19,2)")).first()
    assert (r.target, r.monthly, r.months) == (M("800.00"), M("150.00"), 6)


@pytest.mark.parametrize("active,got", [(2, 2), (4, 0)])
def test_goals_fill_up_to_four(spark, active, got):
    goals = spark.createDataFrame([(1, f"goal {i}", "ACTIVE") for i in range(active)], "owner_id bigint, title string, status string")
    s = spark.createDataFrame([(1, p, t, M("10"), M("1"), 3) for p, t in ((1, "Goal 0"), (1, "new"), (2, "newer"), (3, "newest"))], "person_id bigint, priority int, title string, target decimal(19,2), monthly decimal(19,2), months int")
    out = composites.fill_goals(s, goals).collect()
    assert [r.title for r in out] == ["new", "newer", "newest"][:got]


def test_insights_dedupe_and_order(spark):
    rows = [(1, o, 1, "info", c, m) for o, c, m in ((10, "Food", "a"), (20, " food ", "A "), (30, "x", "y"))] + [(2, i, 1, "info", str(i), "m") for i in range(9)]
    out = composites.first_insights(spark.createDataFrame(rows, "person_id bigint, ord int, rank bigint, type string, category string, message string")).collect()
    assert sorted((r.person_id, r.ord) for r in out) == [(1, 10), (1, 30)] + [(2, i) for i in range(5)]


def test_classifier_order(spark):
    t = tx(spark, *[(1, d, 5, None, None, "2024-01-01") for d in ("my shop", "past thing", "big store", "red gear", "nothing")])
    rules = spark.createDataFrame([(1, "SHOP", "Mine", 1, date(2024, 1, 1)), (1, "my", "Other", 0, date(2024, 2, 1))], "user_id bigint, pattern string, category string, priority int, created_at date")
    past = spark.createDataFrame([("p1", "old PAST thing here")], "tx_id string, description string")
    feedback = spark.createDataFrame([(1, "p1", "Chosen", date(2024, 1, 1))], "user_id bigint, transaction_id string, chosen_category string, created_at date")
    dictionary = spark.createDataFrame([(0, "big|store", "Market", 0.7), (1, "gea", "Wrong", 0.99)], "ordinal int, pattern string, category string, confidence double")
    keywords = spark.createDataFrame([("Tools", "gear", 2.0), ("Tools", "red", 1.0), ("Zoo", "red", 3.0)], "category string, keyword string, weight double")
    out = {r.tx_id: r for r in classifying.classify(t, rules, feedback, past, dictionary, keywords).collect()}
    assert [(out[f"t{i}"].category, out[f"t{i}"].confidence) for i in range(5)] == [("Mine", 0.92), ("Chosen", 0.90), ("Market", 0.7), ("Tools", 0.85), ("Outros", 0.5)]
    assert out["t3"].reason == "keywords:gear,red" and out["t0"].type == "EXPENSE"


def test_statement_text(spark):
    body = "Período 01/01/2024 até 31/01/2024\nSaldo anterior 100,00\nlançamentos\n02/01 SALDO DO DIA 100,00\n05/01 boleto 325,00 D\n06/01 tarifa 34,67D 65,33\n07/01/2024 pix recebido 20,00 C\n07/01 SALDO FINAL 85,33\nlançamentos futuros\n09/02 x 1,00 D"
    docs = spark.createDataFrame([(1, body), (2, body.split("lançamentos\n")[0] + "lançamentos\n05/01 a 1,00 D 06/01 b 2,00 C")], "doc_id bigint, text string")
    rows = texts.parse_statement_text(docs).where("doc_id = 1").orderBy("line_no").collect()
    assert [(r.type, r.amount) for r in rows] == [("BALANCE", M("0.00")), ("DEBIT", M("-325.00")), ("DEBIT", M("-34.67")), ("CREDIT", M("20.00")), ("BALANCE", M("0.00"))]
    assert texts.parse_statement_text(docs).where("doc_id = 2").count() == 2
    head = texts.statement_header(docs).first()
    assert (head.statement_date, head.opening_text) == (date(2024, 1, 31), M("100.00"))


def test_running_balance(spark):
    rows = [(1, 1, M("-5"), None), (1, 2, M("3"), M("50")), (1, 3, M("7"), None), (2, 1, M("4"), None)]
    df = spark.createDataFrame([(d, n, date(2024, 1, 1), a, b) for d, n, a, b in rows], "doc_id bigint, line_no int, date date, amount decimal(19,2), balance decimal(19,2)")
    assert [r.filled for r in texts.fill_balances(df).orderBy("doc_id", "line_no").collect()] == [M("-5.00"), M("50.00"), M("57.00"), M("4.00")]


def test_refund_pairs(spark):
    names = ["Tarifa x", "Estorno tarifa", "Estorno tarifa", "Anuidade", "shop", "Tarifa y", "Tarifa z"]
    df = spark.createDataFrame([(1, i, n, M("9.90"), date(2024, 1, 1)) for i, n in enumerate(names)], "doc_id bigint, line_no int, description string, amount decimal(19,2), date date")
    assert sorted(r.line_no for r in ingesting.cancel_refunds(df).collect()) == [0, 4, 6]


def test_quality(spark):
    docs = spark.createDataFrame([(1, "word " * 200, date(2024, 1, 1), M("10"), "1234"), (2, "short", None, None, None)], "doc_id bigint, text string, due_date date, total_amount decimal(19,2), last_four string")
    rows = spark.createDataFrame([(1, "a", M("1"), date(2024, 1, 1))] * 5 + [(2, "a", M("0"), None)] * 2, "doc_id bigint, description string, amount decimal(19,2), date date")
    assert {r.doc_id: r.score for r in ingesting.parse_quality(docs, rows).collect()} == {1: 100, 2: 0}


def test_duplicates_are_kept(spark):
    df = spark.createDataFrame([(1, "c", date(2024, 1, 1), M("1"), "EXPENSE", "Ab"), (1, "c", date(2024, 1, 1), M("1"), "EXPENSE", "áb ")], "doc_id bigint, card_name string, date date, amount decimal(19,2), type string, description string")
    assert ingesting.remove_duplicates(df).count() == 2 and ingesting.remove_duplicates(df, "drop").count() == 1


def test_money_and_dates(spark):
    df = spark.createDataFrame([("R$ 1.234,56",), ("10,00-",), ("−3,10",), ("x",)], "s string")
    assert [r[0] for r in df.select(money.parse_brazilian(F.col("s"))).collect()] == [M("1234.56"), M("-10.00"), M("-3.10"), None]
    days = spark.createDataFrame([("05 MAI",), ("2024-02-30",), ("31/12",), ("1/1",), ("03/04/23",)], "s string")
    got = [r[0] for r in days.select(dates.parse_date(F.col("s"), F.lit("2024-06-15").cast("date"))).collect()]
    assert got == [date(2024, 5, 5), None, date(2023, 12, 31), date(2024, 1, 1), date(2023, 4, 3)]
    assert spark.range(1).select(text.description_key(F.lit(" NETFLIX.com  BR 123 ")), text.merchant(F.lit("PAG*Loja São 1"))).first()[:] == ("netflix", "LOJA SAO 1")


def test_half_year_before(spark):
    t = tx(spark, (1, "a", 10, "INCOME", "A", "2023-12-31"), (1, "a", 30, "INCOME", "A", "2024-03-01"))
    r = summaries.period_summary(t, "SEMIANNUAL").where("period_start = '2024-01-01'").first()
    assert (r.income, r.previous_income, r.period_end) == (M("30.00"), M("10.00"), date(2024, 6, 30))


def test_asset_sync(spark):
    inv = spark.createDataFrame([(1, 9, M("5"), False), (2, 9, M("6"), True), (3, 9, M("7"), False)], "investment_id bigint, owner_id bigint, current_value decimal(19,2), excluded boolean")
    assets = spark.createDataFrame([(10, 1, M("4"), True), (11, 2, M("6"), True), (12, 3, M("7"), True)], "asset_id bigint, investment_id bigint, current_value decimal(19,2), synced boolean")
    assert {r.asset_id: r.action for r in portfolio.sync_assets(inv, assets).collect()} == {10: "update", 11: "delete"}


def test_invoice_gap_gives_no_change(spark):
    m = spark.createDataFrame([(1, 2023, 12, M("10")), (1, 2024, 1, M("15")), (1, 2024, 3, M("20"))], "card_id bigint, year int, month int, total decimal(19,2)")
    got = {(r.year, r.month): r.change for r in invoicing.month_over_month(m).collect()}
    assert got == {(2023, 12): None, (2024, 1): M("0.500000"), (2024, 3): None}


def test_reports_and_scores_are_written(spark, tmp_path):
    scores = spark.createDataFrame([(1, 80, date(2024, 1, 31)), (1, 70, date(2024, 2, 29))], "person_id bigint, score int, calculation_date date")
    for _ in range(2):
        texts.write_scores(scores, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    texts.write_reports(spark.createDataFrame([(1, "ANNUAL", date(2024, 1, 1), "{}")], "person_id bigint, report_type string, period_start date, data string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿\ndata,descricao,valor,categoria\n01/02/2024,Café,-12.50,Food\nbroken\n\n2024-02-03,b,3.00,\n", encoding="utf-8")
    rows, rejected = texts.read_csv_exports(spark, str(tmp_path))
    assert [(r.date, r.amount, r.type) for r in rows.orderBy("line_no").collect()] == [(date(2024, 2, 1), M("12.50"), "INCOME"), (date(2024, 2, 3), M("3.00"), "EXPENSE")]
    assert rejected.count() == 1


def test_quota_is_anchored(spark):
    times = ["00:00", "00:10", "00:59", "01:00", "01:01", "01:02"]
    df = spark.createDataFrame([(i, "k", f"2024-01-01 {t}:00") for i, t in enumerate(times)], "event_id bigint, ip string, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = {r.event_id: r.allowed for r in audit.quota(df, "ip", limit=2).collect()}
    assert out == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}


def test_quota_stream(spark, tmp_path):
    """The stateful stream allows what the batch form does."""
    times = ["00:00", "00:10", "00:59", "01:00", "01:01", "01:02"]
    df = spark.createDataFrame([(i, k, f"2024-01-01 {t}:00") for k in ("a", "b") for i, t in enumerate(times, 10 * (k == "b"))], "event_id bigint, ip string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = audit.quota_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ip", limit=2)
        out.writeStream.format("memory").queryName("quotas").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.event_id: r.allowed for r in spark.table("quotas").collect()}
    assert len(got) == 12 and got == {r.event_id: r.allowed for r in audit.quota(df, "ip", limit=2).collect()}


def test_yearless_dates(spark):
    """29 February is a date of leap years only; as_of chooses the year."""
    day = lambda x, as_of: spark.range(1).select(parse_date(F.lit(x), F.lit(as_of).cast("date"))).first()[0]
    assert day("29/02", "2024-03-10") == day("29 FEV", "2024-12-31") == date(2024, 2, 29)
    assert day("29/02", "2023-03-10") is None and day("29/02", "2025-01-05") == date(2024, 2, 29) and day("31/02", "2024-03-01") is None
    assert day("10/12", "2024-01-05") == date(2023, 12, 10) and day("05/02", "2024-01-05") == date(2024, 2, 5)
    docs = spark.createDataFrame([(1, "fatura de x\nvencimento 10/03/2024\n29 FEV Cafe R$ 5,00"), (2, "fatura de x\nvencimento 10/01/2025\n29 FEV Cafe R$ 5,00"), (3, "fatura de x\nvencimento 10/03/2023\n29 FEV Cafe R$ 5,00")], "doc_id int, text string")
    got = {r.doc_id: r.date for r in texts.parse_invoice_text(docs, spark.createDataFrame(texts.LAYOUTS, texts.LAYOUT_SCHEMA)).collect()}
    assert got == {1: date(2024, 2, 29), 2: date(2024, 2, 29), 3: None}


def test_trips_stay(spark):
    rows = [(1, "a", "EXPENSE", "Food", None, None), (1, "b", "EXPENSE", "Food", "old", "hotel"), (1, "c", "INCOME", "Food", None, None), (1, "d", "EXPENSE", "Food", None, "hotel"), (1, "e", "EXPENSE", "Food", "old", None)]
    df = spark.createDataFrame(rows, "person_id int, tx_id string, type string, category string, trip_id string, trip_subcategory string")
    chosen = spark.createDataFrame([(1, x, "new") for x in "abcd"], "person_id int, tx_id string, trip_id string")
    out = {r.tx_id: (r.category, r.trip_id, r.trip_subcategory) for r in invoicing.apply_trip(df, chosen).collect()}
    assert out == {"a": ("Viagem", "new", "Food"), "b": ("Food", "old", "hotel"), "c": ("Food", None, None), "d": ("Viagem", "new", "hotel"), "e": ("Food", "old", None)}


def test_subscription_cleanup_wants_three(spark):
    """With the default threshold: three subscriptions in all three months make a goal, two don't."""
    rows = [(p, f"{name} plan", 12 + k, "EXPENSE", "Services", f"2024-0{m}-05") for p, n in ((1, 3), (2, 2)) for k, name in enumerate("alpha beta gamma".split()[:n]) for m in (1, 2, 3)]
    out = composites.subscription_cleanup(tx(spark, *rows), "2024-03-31").collect()
    assert [(r.person_id, r.target) for r in out] == [(1, M("39.00"))]


def test_feedback_by_runs(spark):
    """The index finds what comparing each description with all of its person's history does, short ones as well."""
    pasts = ["padaria sol", "sol", "uber trip 12", "supermercado sol e mar", "uber", "aaaaaaa"]
    targets = ["sol", "uber", "ub", "aaaa", "aaaaaaaa", "mercado", "sol e", "x"]
    history = spark.createDataFrame([(p, x, "c", date(2024, 1, 1), 1) for p in (1, 2) for x in pasts[p - 1 :]], "person_id int, past string, chosen_category string, created_at date, times int")
    wanted = spark.createDataFrame([(p, x.upper(), x) for p in (1, 2, 3) for x in targets], "person_id int, description string, target string")
    got = sorted((r.person_id, r.target, r.past) for r in classifying._held_by(wanted, history).collect())
    assert got == sorted((p, x, y) for p in (1, 2) for x in targets for y in pasts[p - 1 :] if x in y)


def test_dictionaries_by_runs(spark):
    """Merchants and keywords found by the index are those found by trying each pattern on each text."""
    texts = ["Uber trip", "uber", "PAG uber eats", "tv", "tv box", "atv", "", None, "x", "abc loja", "abcd loja", "loja abc sol", "a a", "Açaí do Zé"]
    patterns = ["uber", "uber|trip", "tv", "abc|loja", "loja", "a", "acai", "sol|abc|loja", "eats|uber", "zzzz", "ze", "ube"]
    frame = spark.createDataFrame([(t,) for t in texts], "description string")
    dictionary = spark.createDataFrame([(i, p, f"c{i}", 0.5 + (i % 3) / 10) for i, p in enumerate(patterns)] + [(99, None, "none", 0.9)], "ordinal int, pattern string, category string, confidence double")
    plain = {None: None, "Açaí do Zé": "acai do ze"}
    plain = {t: plain.get(t, t and t.lower()) for t in texts}
    holds = lambda t, p: f" {p} " in f" {t} " if len(p) <= 3 else p in t
    want = {}
    for t in texts:
        found = [(0.5 + (i % 3) / 10, len(p.replace("|", "")), -i, f"c{i}") for i, p in enumerate(patterns) if t is not None and all(holds(plain[t], x) for x in p.split("|"))]
        want[t] = max(found)[3] if found else None
    got = classifying.by_merchant(frame, dictionary).collect()
    assert {r.description: r.merchant and r.merchant.category for r in got} == want and len(got) == len(texts)
    words = [("A", "uber", 1.0), ("A", "tv", 2.0), ("B", "u", 1.0), ("B", "loja", 0.5), ("C", "loja", 0.5), ("C", "abcd", 0.25), ("C", "abcd", 0.25), ("D", "acai do", 3.0)]
    want = {}
    for t in texts:
        sums = {c: sum(w for d, k, w in words if d == c and t is not None and k in plain[t]) for c in "ABCD"}
        want[t] = min((-s, c) for c, s in sums.items()) if any(sums.values()) else None
    got = classifying.by_keywords(frame, spark.createDataFrame(words, "category string, keyword string, weight double")).collect()
    assert {r.description: r.keyword and (-r.keyword.score, r.keyword.category) for r in got} == want


def test_small_tables(spark):
    assert small(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        small(spark.range(3), 2)


def test_pushdown(spark):
    """The scans below the base cube read only the columns that it needs, and a range of dates reaches the scan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    cube = plan(summaries.base_cube(view(spark, "/root/testdata/sf0.001", "tx")))
    assert "l_extendedprice" in cube and not any(c in cube for c in ("l_tax", "l_comment", "o_comment", "p_brand", "p_name", "l_shipmode"))
    some = plan(summaries.live(view(spark, "/root/testdata/sf0.001", "tx")).where("transaction_date between '1995-01-01' and '1995-01-31'"))
    assert "PushedFilters" in some and "l_shipdate" in some.split("PushedFilters", 1)[1]
