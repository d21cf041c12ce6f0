"""Charts from transactions and statements, report sections, insights of all months, providers that fail, word tables, Unicode."""

import json
import sys
import unicodedata
from datetime import date
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import normalize
from tallyspark.operators import classifying, composites, detection, summaries
from tallyspark.sources.testdata import AS_OF, view

SF = "/root/testdata/sf0.001"
TX = "tx_id string, person_id bigint, description string, amount decimal(19,2), type string, category string, transaction_date date, purchase_date date, deleted_at date"
STX = "stx_id bigint, user_id bigint, transaction_date date, description string, type string, amount decimal(19,2)"


@pytest.fixture(scope="module")
def sides(spark):
    d = date(2024, 5, 3)
    tx = [("a", 1, "shop", M(100), "EXPENSE", "Food", d, d, None), ("b", 1, "cash", M(40), "EXPENSE", None, d, None, None), ("c", 1, "job", M(500), "INCOME", "Job", d, None, None), ("d", 1, "gone", M(9), "EXPENSE", "Food", d, None, d)]
    stx = [(1, 1, d, "market", "DEBIT", M(-60)), (2, 1, d, "salary", "CREDIT", M(700)), (3, 1, d, "pagamento fatura", "DEBIT", M(-100)), (4, 1, d, "saldo", "BALANCE", M(900)), (5, 2, d, "other person", "DEBIT", M(-5)), (6, 1, date(2024, 4, 30), "earlier", "DEBIT", M(-1))]
    return spark.createDataFrame(tx, TX), spark.createDataFrame(stx, STX)


def test_charts_take_statements_in(spark, sides):
    rules = spark.createDataFrame([(0, "DEBIT", ["market"], "Food")], "ordinal int, type string, patterns array<string>, category string")
    cube = summaries.charts_cube(*sides, rules)
    may = {r.person_id: r for r in summaries.monthly_evolution(cube, "2024-01-01", 12).where("month = '2024-05-01'").collect()}
    assert (may[1].income, may[1].expenses, may[1].income_checking, may[1].expenses_checking, may[1].expenses_card) == (M("1200.00"), M("200.00"), M("700.00"), M("100.00"), M("100.00"))
    assert (may[2].income, may[2].expenses_checking) == (M("0.00"), M("5.00"))
    parts = {(r.person_id, r.month, r.category): (r.total, r.percent) for r in summaries.category_breakdown(cube).collect()}
    assert parts[1, date(2024, 5, 1), "Food"] == (M("160.00"), M("80.00")) and parts[1, date(2024, 5, 1), "Outros"] == (M("40.00"), M("20.00")) and parts[1, date(2024, 4, 1), "Outros"] == (M("1.00"), M("100.00"))
    year = {(r.person_id, r.category): r.total for r in summaries.category_breakdown(cube, "year").collect()}
    assert year == {(1, "Food"): M("160.00"), (1, "Outros"): M("41.00"), (2, "Outros"): M("5.00")}


def test_statement_section_of_reports(spark, sides):
    ends = spark.createDataFrame([(1, date(2024, 2, 29), M(10), M(20)), (1, date(2024, 5, 31), M(20), M(900))], "user_id bigint, statement_date date, opening_balance decimal(19,2), closing_balance decimal(19,2)")
    got = {r.person_id: r.statements for r in composites.period_statements(sides[1], ends, "ANNUAL", rows=3).collect()}
    s = got[1]
    assert (s.opening, s.closing, s.credits, s.expenses, s.balance, s.n, [r.stx_id for r in s.rows]) == (M(10), M(900), M("700.00"), M("161.00"), M("539.00"), 5, [6, 1, 2])
    assert (got[2].opening, got[2].n, len(got[2].rows)) == (None, 1, 1)


@pytest.fixture(scope="module")
def inputs(spark):
    names = ("recurring", "stx", "cards", "invoices", "goals")
    tx, stx, cards, invoices, goals = (view(spark, SF, n) for n in names)
    return {"cube": summaries.base_cube(tx), "flow": summaries.cashflow(tx, stx), "cards": cards, "invoices": invoices, "goals": goals, "as_of": AS_OF}


def test_a_provider_that_fails_fails_alone(spark, inputs):
    def broken(x, m):
        raise RuntimeError("no rates today")

    late = {**composites.PROVIDERS, "broken": broken, "late": lambda x, m: x["cube"].select("person_id", F.lit(1).alias("ord"), F.lit(1).cast("bigint").alias("rank"), F.lit("info").alias("type"), F.lit("c").alias("category"), F.raise_error(F.lit("in a task")).cast("string").alias("message"))}
    found, failures = composites.run_providers(inputs, "2000-06-01", late)
    assert {(r.provider, r.error) for r in failures.collect()} >= {("broken", "RuntimeError")} and {r.provider for r in failures.collect()} == {"broken", "late"}
    assert "no rates today" in {r.message for r in failures.collect()}
    key = lambda df: sorted(map(str, composites.first_insights(df).collect()))
    alone, none = composites.run_providers(inputs, "2000-06-01")
    assert key(found) == key(alone) and none.count() == 0 and len(key(found)) > 50
    nothing, all_failed = composites.run_providers(inputs, "2000-06-01", {"broken": broken})
    assert nothing.count() == 0 and all_failed.count() == 1


def test_insights_fail_where_a_provider_does(spark, inputs, monkeypatch):
    """What a failing provider would have said was missing from the result, in the query too, and nothing told so."""
    from tallyspark.plans.registry import QUERIES

    def broken(x, m):
        raise OSError("no space left")

    in_task = lambda x, m: x["cube"].select("person_id", F.lit(1).alias("ord"), F.lit(1).alias("rank"), F.lit("info").alias("type"), F.lit("c").alias("category"), F.raise_error(F.lit("in a task")).cast("string").alias("message"))
    cashflow = {"cashflow": composites.PROVIDERS["cashflow"]}
    for name, f in (("broken", broken), ("late", in_task)):
        with pytest.raises(RuntimeError, match=f"{name} .*(no space left|in a task)"):
            composites.insights(inputs, "2000-06-01", cashflow | {name: f})
    assert composites.insights(inputs, "2000-06-01", cashflow).count() > 0
    monkeypatch.setitem(composites.PROVIDERS, "growth", broken)
    with pytest.raises(RuntimeError, match="growth .OSError: no space left"):
        QUERIES["in_tk4_so3_so6_insights"](spark, SF)


def test_insights_of_every_month(spark, inputs):
    """Months at once give what the providers give month by month; reports keep the last ones of their periods."""
    flow = inputs["flow"]
    both = composites.monthly_insights(inputs["cube"], flow, inputs["cards"], inputs["invoices"], inputs["goals"], every=6)
    assert {r.month.month for r in both.select("month").distinct().collect()} <= {6, 12}
    for month, as_of in (("2000-06-01", "2000-06-30"), ("1999-12-01", "1999-12-31")):
        want = sorted((r.person_id, r.ord, r.rank, r.message) for r in composites.insights(inputs | {"as_of": as_of}, month).collect())
        rows = both.where(F.col("month") == month).select("person_id", F.explode("insights").alias("i"))
        assert sorted((r.person_id, r.i.ord, r.i["rank"], r.i.message) for r in rows.collect()) == want and want
    months = detection.recurring_by_month(flow)
    for as_of in ("2000-06-30", "2000-04-10"):
        want = sorted(map(str, detection.recurring(flow, as_of).collect()))
        assert sorted(map(str, months.where(F.col("month") == F.trunc(F.lit(as_of).cast("date"), "month")).drop("month").collect())) == want


def test_reports_hold_statements_and_all_insights(spark):
    names = ("recurring", "investments", "budgets", "assets", "goals", "stx", "statements", "cards", "invoices")
    tx, *rest = (view(spark, SF, n) for n in names)
    docs = [json.loads(r.data) for r in composites.period_reports(tx, "SEMIANNUAL", *rest).where("period_start = '2000-01-01'").collect()]
    assert len(docs) > 50 and all(len(d.get("insights", [])) <= 5 for d in docs)
    assert {i["ord"] for d in docs for i in d.get("insights", [])} >= {5, 10, 20, 40}
    with_rows = [d["statements"] for d in docs if "statements" in d]
    assert with_rows and all(len(s["rows"]) == min(s["n"], 200) and s["limited_to"] == 200 for s in with_rows)


def test_words_are_parts_of_texts(spark):
    tx = spark.createDataFrame([(1, "Transferência de José", None), (2, "Netflix", None), (3, "PLAN X", "x"), (4, "", None), (5, "gym", "Assinaturas")], "id int, description string, category string").select("*", F.lit("EXPENSE").alias("type"), F.lit(10).alias("amount"))
    words = spark.createDataFrame([("transfer", "transferencia"), ("subscription", "flix"), ("subscription", "plan"), ("essential", "assin")], "kind string, pattern string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(detection.subscription_candidates(tx, words)) == [2, 3, 5] and ids(detection.subscription_candidates(tx, words, positive=True)) == [2, 3, 5]
    assert ids(detection.subscription_candidates(tx)) == [2, 3, 5] and ids(detection.subscription_candidates(tx, positive=True)) == [3, 5]
    assert {r.category: r.reducible for r in detection.reducible(tx.where("category is not null"), words).collect()} == {"x": True, "Assinaturas": False}
    labels = spark.createDataFrame([(0, ["saude", "medic"], "Saúde"), (1, ["med"], "Later")], "ordinal int, patterns array<string>, label string")
    got = {r.category: r.label for r in classifying.category_labels(spark.createDataFrame([("Planos de SAÚDE",), ("remedio",), ("Other",), (None,), (" Own ",)], "category string"), labels).collect()}
    assert got == {"Planos de SAÚDE": "Saúde", "remedio": "Later", "Other": "Outros", None: "Outros", " Own ": " Own "}


def test_all_letters_lose_their_marks(spark):
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo", "Lm") and not 0xAC00 <= c <= 0xD7A3]
    chunks = ["".join(letters[i : i + 500]).lower() for i in range(0, len(letters), 500)] + [None, "", "각 x́"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in chunks], "t string").coalesce(1).select(normalize(F.col("t"), unicode=True)).collect()]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    # Java and Python may know other versions of Unicode: what Java's lower case changes is left out
    low = [r[0] for r in spark.createDataFrame([(c,) for c in chunks], "t string").coalesce(1).select(F.lower("t")).collect()]
    assert got == [None if t is None else plain(t).strip() for t in low]
    assert spark.createDataFrame([("ǆ Ǻ",)], "t string").select(normalize(F.col("t"))).first()[0] != "ǆ a"  # off unless asked for


def test_keys_of_recurring_rows_are_found_once(spark, monkeypatch):
    """A row counts in the spans of three months; its key was computed in each."""
    calls, plain = spark.sparkContext.accumulator(0), detection.description_key
    counted = F.udf(lambda x: (calls.add(1), x)[1], "string").asNondeterministic()
    monkeypatch.setattr(detection, "description_key", lambda x: counted(plain(x)))
    rows = [(f"t{m}", 1, "gym plan", M(30), "EXPENSE", None, date(2024, m, 5), None, None) for m in (1, 2, 3, 4)]
    counts = detection.recurring_by_month(spark.createDataFrame(rows, TX))
    got = sorted((r.month, r.n, r.monthly_cost) for r in counts.collect())
    assert got == [(date(2024, 3, 1), 3, M("30.00")), (date(2024, 4, 1), 3, M("30.00"))]
    assert calls.value % len(rows) == 0 and calls.value <= 3 * len(rows)  # the plan reads its rows three times at most


def test_no_document_is_shuffled(spark):
    """Breakdowns and statements of a person's period were shuffled together for each later section."""
    names = ("tx", "investments", "budgets", "assets", "goals", "stx", "statements", "cards", "invoices")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are larger than these
    try:
        reports = composites.period_reports(*(view(spark, SF, n) for n in names[:1]), "ANNUAL", *(view(spark, SF, n) for n in names[1:]))
        plan = spark._jvm.PythonSQLUtils.explainString(reports._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = [part for part in plan.split("\n\n") if ") Exchange" in part]
    assert moved and any("breakdown#" in m for m in moved)
    assert not [m for m in moved if "breakdown#" in m and "statements#" in m]


def test_periods_before_of_rows_without_a_date(spark, sides):
    """The period before is a year away, not the last one with rows; rows without a date have none."""
    tx = sides[0].unionByName(spark.createDataFrame([("x", 1, "old", M(7), "EXPENSE", None, date(2023, 1, 1), None, None), ("y", 1, "older", M(3), "EXPENSE", None, date(2021, 1, 1), None, None), ("z", 1, "undated", M(2), "EXPENSE", None, None, None, None)], TX))
    got = {r.period_start: (r.expenses, r.previous_expenses, r.expense_change) for r in summaries.period_summary(tx, "ANNUAL").collect()}
    assert got == {date(2024, 1, 1): (M(140), M(7), M(133)), date(2023, 1, 1): (M(7), M(0), M(7)), date(2021, 1, 1): (M(3), M(0), M(3)), None: (M(2), M(0), M(2))}


def test_recurring_rows_are_read_once_and_labels_go_by_name(spark, monkeypatch):
    """Rows were read for each of three uses of their counts, and descriptions that tie in number, amount and date went by the row's id."""
    calls, plain = spark.sparkContext.accumulator(0), detection.description_key
    counted = F.udf(lambda x: (calls.add(1), x)[1], "string").asNondeterministic()
    monkeypatch.setattr(detection, "description_key", lambda x: counted(plain(x)))
    rows = [(f"{t}{m}", 1, name, M(30), "EXPENSE", None, date(2024, m, 5), None, None) for m in (1, 2, 3) for t, name in (("a", "gym 2"), ("b", "gym 1"))]
    got = detection.recurring_by_month(spark.createDataFrame(rows, TX)).collect()
    assert [(r.month, r.label, r.n) for r in got] == [(date(2024, 3, 1), "gym 1", 6)] and calls.value == len(rows)


def test_insights_of_a_month_aggregate_its_months_only(spark, inputs, monkeypatch):
    """The cube of all months was written for the insights of one; a provider of one's own still gets all of it."""
    written, plain = {}, composites.saved
    monkeypatch.setattr(composites, "saved", lambda df, name: written.update({name: plain(df, name)}) or written[name])
    own = lambda x, m: x["cube"].groupBy("person_id").agg(F.min("month").alias("first")).select("person_id", F.lit(1).alias("ord"), F.lit(1).cast("bigint").alias("rank"), F.lit("info").alias("type"), F.lit("c").alias("category"), F.col("first").cast("string").alias("message"))
    found, none = composites.run_providers(inputs, "2000-06-01", {**composites.PROVIDERS, "own": own})
    months = {r.month for r in written["insights-cube"].select("month").distinct().collect()}
    assert months == {date(2000, m, 1) for m in (3, 4, 5, 6)} and none.count() == 0
    assert {r.message for r in found.where("category = 'c'").collect()} & {"1995-01-01", "1995-02-01", "1995-03-01"}
    # one that compares with three months before: without the first of them there is another mean
    tx = [(f"t{i}", 1, "x", M(v), "EXPENSE", "Food", date(2024, i, 3), None, None) for i, v in ((1, 900), (2, 100), (3, 100), (4, 100), (5, 300))]
    cube = summaries.base_cube(spark.createDataFrame(tx, TX))
    got, _ = composites.run_providers(inputs | {"cube": cube}, "2024-05-01", {"anomaly": composites.PROVIDERS["anomaly"]})
    assert [(r.type, r.message) for r in got.collect()] == [("alert", "unusual 300.00")]
