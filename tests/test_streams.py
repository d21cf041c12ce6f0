"""Corrected totals and anchored quotas against what is left and against a sequential replay."""

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import summaries
from tallyspark.streaming import audit

CHANGES = "tx_id string, version bigint, person_id bigint, transaction_date date, type string, category string, amount decimal(19,2), deleted boolean, description string"


@pytest.mark.parametrize("seed,every", [(1, 2), (2, 100)])
def test_totals_after_corrections(spark, tmp_path, seed, every):
    """Inserts, deletions, re-dated and re-categorised rows in any order, a batch that runs twice: as AG3 over what is left."""
    rng = random.Random(seed)
    changes = [
        (f"t{rng.randrange(25)}", v, rng.randrange(3), date(2024, rng.randint(1, 3), rng.randint(1, 28)), rng.choice(["INCOME", "EXPENSE"]), rng.choice(["a", "b", None]), rng.choice([M("1.10"), M("250.00"), M("-3.00"), None]), rng.random() < 0.3, rng.choice(["ok", "casino night"]))
        for v in range(160)
    ]
    rng.shuffle(changes)
    kept = audit.CorrectedTotals(spark, str(tmp_path / "t"), every)
    flags = dict(threshold=200, risky=["b"], keywords=["casino"])
    for i in range(7):
        batch = audit.flagged(spark.createDataFrame(changes[i * 23 : i * 23 + 23], CHANGES), flags)
        for _ in range(2 if i in (2, 3, 6) else 1):
            kept.apply(batch, i)
        newest = {}
        for c in changes[: i * 23 + 23]:
            if c[0] not in newest or c[1] > newest[c[0]][1]:
                newest[c[0]] = c
        left = spark.createDataFrame([c for c in newest.values() if not c[7]], CHANGES)
        if i in (3, 6):
            want = {(r.person_id, r.month, r.type): (r.total, r.n) for r in summaries.month_type_totals(left).collect()}
            got = {(r.person_id, r.month, r.type): (r.total, r.n) for r in kept.totals().collect()}
            none = M("0.00")
            assert {k: (t or none, n) for k, (t, n) in got.items()} == {k: (t or none, n) for k, (t, n) in want.items()}
            critical = audit.flagged(left, flags).where("critical").groupBy("person_id").count().collect()
            assert {r[0]: r[1] for r in kept.totals().groupBy("person_id").agg(F.sum("n_critical")).where("`sum(n_critical)` > 0").collect()} == {r[0]: r[1] for r in critical}
    # what the last snapshot but one holds is gone from the folders of batches
    assert len(kept._numbers("rows")) <= 2 * every + 1


def test_corrected_totals_as_a_stream(spark, tmp_path):
    first = [("a", 1, 1, date(2024, 1, 1), "EXPENSE", "x", M(10), False, ""), ("b", 1, 1, date(2024, 1, 2), "EXPENSE", "x", M(5), False, "")]
    second = [("a", 2, 1, date(2024, 2, 1), "EXPENSE", "y", M(10), False, ""), ("b", 2, 1, date(2024, 1, 2), "EXPENSE", "x", M(5), True, ""), (None, 1, 1, None, None, None, None, None, None)]
    kept = audit.CorrectedTotals(spark, str(tmp_path / "t"))
    assert kept.totals().count() == 0
    for rows in (first, second):
        spark.createDataFrame(rows, CHANGES).write.mode("append").parquet(str(tmp_path / "in"))
        kept.start(spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))).awaitTermination()
    assert [tuple(r) for r in kept.cells().collect()] == [(1, date(2024, 2, 1), "EXPENSE", "y", False, M("10.00"), 1)]


def allowed(events, limit, seconds):
    state, out = {}, {}
    for i, k, t in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        anchor, used = state.get(k, (None, 0))
        if anchor is None or t >= anchor + timedelta(seconds=seconds):
            anchor, used = t, 0
        state[k] = (anchor, used + 1)
        out[i] = used + 1 <= limit
    return out


@pytest.mark.parametrize("folded", [0, 40])
def test_quota_of_hot_keys(spark, folded):
    """Keys in slices of time equal the sequential form: ties, gaps of many windows, times at a window's end, times before 1970."""
    rng = random.Random(folded)
    base = datetime(2024, 1, 1)
    events = [(i, "hot", base + timedelta(seconds=rng.randrange(0, 3000))) for i in range(900)]
    events += [(1000 + i, f"k{rng.randrange(6)}", base + timedelta(seconds=rng.choice([1, 10, 60, 61, 1000]) * rng.randrange(0, 400))) for i in range(500)]
    events += [(2000 + i, "exact", base + timedelta(seconds=60 * i)) for i in range(70)] + [(3000 + i, "old", datetime(1969, 12, 31, 23, 59) + timedelta(seconds=7 * i)) for i in range(40)]
    df = spark.createDataFrame(events + [(9998, None, base), (9999, "hot", None)], "event_id bigint, ip string, ts timestamp")
    for limit, seconds in ((2, 60), (1, 7)):
        got = {r.event_id: r.allowed for r in audit.quota(df, "ip", limit, seconds, folded).collect()}
        assert got == allowed(events, limit, seconds)
    assert audit.quota(df.where("false"), "ip", folded=folded).count() == 0


def test_slices_of_a_hot_key_are_many_tasks(spark):
    """No plan partitions the events of a key by the key alone."""
    rows = spark.range(5000).selectExpr("id as event_id", "'hot' as ip", "timestamp_seconds(id * 30) as ts")
    plan = audit.quota(rows, "ip", 20, 3600, folded=0)._jdf.queryExecution().executedPlan().toString()
    assert "mapInPandas" not in plan and "ArrowEval" not in plan
    counts = Counter(r.allowed for r in audit.quota(rows, "ip", 20, 3600, folded=0).collect())
    assert counts == Counter(r for r in allowed([(i, "hot", datetime(2024, 1, 1) + timedelta(seconds=30 * i)) for i in range(5000)], 20, 3600).values())
