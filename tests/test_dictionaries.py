"""Lookups of descriptions in feedback, dictionaries and rules of any size, against brute force."""

import random
from datetime import date

from pyspark.sql import functions as F

from tallyspark.operators import classifying


def test_feedback_of_a_heavy_user(spark):
    """Targets that begin with each other, that are shorter than four characters, and that a past description holds twice."""
    rng = random.Random(4)
    words = ["pix", "transf", "joao", "a", "bc", "mercado", "é", "99"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    past = [(f"t{i}", "pix transf joao pix transf joao" if i == 0 else text(rng.randint(1, 6))) for i in range(300)]
    feedback = [(1 if i % 3 else 2, f"t{rng.randrange(300)}", rng.choice("xyz"), date(2024, 1, rng.randint(1, 28))) for i in range(400)]
    new = [(1 + i % 2, d) for i, d in enumerate(["pix", "pix transf", "pix transf joao", "a", "bc", "é", "99 99", "nowhere", "", "  ", "mercado", "p", "x t"] * 2 + [text(rng.randint(1, 3)) for _ in range(40)])]
    tx = spark.createDataFrame(new, "person_id bigint, description string")
    rows = classifying.by_feedback(tx, spark.createDataFrame(feedback, "user_id bigint, transaction_id string, chosen_category string, created_at date"), spark.createDataFrame(past, "tx_id string, description string"), newest=5)
    got = {(r.person_id, r.description): (r.feedback_category, r.votes) for r in rows.collect()}
    held, want = dict(past), {}
    for person, d in set(new):
        target = " ".join(d.lower().replace("é", "e").split())[:80]
        hits = [(c, day, held[t].lower()) for u, t, c, day in feedback if u == person and target and target in held[t].lower()]
        hits = sorted(hits, key=lambda h: (-h[1].toordinal(), h[0], h[2]))[:5]
        if hits:
            votes = {c: (sum(h[0] == c for h in hits), max(h[1] for h in hits if h[0] == c)) for c, _, _ in hits}
            best = min(votes, key=lambda c: (-votes[c][0], -votes[c][1].toordinal(), c))
            want[person, d] = (best, votes[best][0])
    assert got == want and len(want) > 20


def test_feedback_of_ordinary_users_is_tried_directly(spark, monkeypatch):
    """Texts of users with few pairs are not cut into suffixes; those of a heavy user are, and both ways agree."""
    text = lambda i: f"pix {'ab' * (i % 7)} shop {i % 40}"
    past = spark.createDataFrame([(f"t{i}", text(i)) for i in range(400)], "tx_id string, description string")
    feedback = spark.createDataFrame([(1 if i % 20 else 2, f"t{i}", "xyz"[i % 3], date(2024, 1, 1 + i % 28)) for i in range(400)], "user_id bigint, transaction_id string, chosen_category string, created_at date")
    tx = spark.createDataFrame([(u, d) for u in (1, 2) for d in [text(i)[:n] for i in range(60) for n in (3, 6, 40)] + [""]], "person_id bigint, description string")
    seen, held = [], classifying._held_by
    monkeypatch.setattr(classifying, "_held_by", lambda wanted, history: seen.extend({r.person_id for r in history.collect()}) or held(wanted, history))
    rows = lambda most: sorted(map(tuple, classifying.by_feedback(tx, feedback, past, newest=5, most=most).collect()))
    direct = rows(10_000)
    assert not seen and {r[0] for r in direct} == {1, 2}
    assert rows(20) == direct and seen == [1]
    assert rows(0) == direct and set(seen[1:]) == {1, 2}


def test_dictionaries_beyond_any_broadcast(spark):
    """70,000 patterns are no error, and the lookup gives what trying all of them would."""
    merchants = spark.range(70_000).select(F.col("id").alias("ordinal"), F.concat(F.lit("shop"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("category"), F.lit(0.8).alias("confidence"))
    merchants = merchants.unionByName(spark.createDataFrame([(70_001, "ab", "short", 0.9), (70_002, "shop|ab", "both", 0.9)], "ordinal bigint, pattern string, category string, confidence double"))
    texts = spark.createDataFrame([("pay SHOP012345 now",), ("ab",), ("cabs",), ("shop000007 ab",), ("none",)], "description string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.description: r.merchant and r.merchant.category for r in classifying.by_merchant(texts, merchants).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"pay SHOP012345 now": "c4", "ab": "short", "cabs": None, "shop000007 ab": "both", "none": None}


def test_first_rule_by_ordinal_and_type(spark):
    rng = random.Random(9)
    rules = [(i, rng.choice([None, "CREDIT", "DEBIT"]), rng.sample(["ab", "abc", "b c", "zz", "x", "long word", ""][: 6 + (i == 39)], 2), f"c{i}") for i in range(40)]
    rows = [(" ".join(rng.choice(["ab", "abc", "b", "c", "zz", "x1", "Long", "word"]) for _ in range(rng.randint(1, 3))), rng.choice(["CREDIT", "DEBIT", None])) for _ in range(120)]
    df = spark.createDataFrame(rows, "description string, type string")
    got = sorted((r.description, str(r.type), r.rule_category) for r in classifying.ordered_rule(df, spark.createDataFrame(rules, "ordinal int, type string, patterns array<string>, category string")).collect())
    first = lambda d, t: next((c for _, kind, ps, c in rules if kind in (None, t) and any(p in d.lower() for p in ps)), "Outros")
    assert got == sorted((d, str(t), first(d, t)) for d, t in rows)
