"""Phrase mining, line deduplication and periodic runs against brute force and SQL, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import op11_phrases, op12_lines, op13_periodic
from tallyspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_phrases", "op12_lines"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(str(dict(sorted(zip(names, r)))) for r in cur.fetchall())
    assert sorted(str(dict(sorted(r.asDict().items()))) for r in QUERIES[name](spark, SF).collect()) == want


def counted(rows, least, longest):
    """All frequent phrases of rows (lang, text), and the words of each language, by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return {p: c for p, c in f.items() if c >= least}, n


def collocations(rows, least, longest, top, covered):
    f, n = counted(rows, least, longest)
    out = []
    for (lang, k, phrase), a in f.items():
        w = phrase.split(" ")
        within = lambda other: any(other[i : i + k] == w for i in range(len(other) - k + 1))  # noqa: B023, E731
        if k < 2 or any(k2 > k and l2 == lang and 100 * b >= covered * a and within(p2.split(" ")) for (l2, k2, p2), b in f.items()):
            continue
        cuts = [(f[lang, c, " ".join(w[:c])], f[lang, k - c, " ".join(w[c:])]) for c in range(1, k)]
        score, _, l, r = min((1_000_000 * a * a // (l * r), i, l, r) for i, (l, r) in enumerate(cuts))
        out.append((lang, -score, -a, phrase.encode(), l, r))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def corpus(rng, n_docs=150):
    rows = [(None, None), ("en", ""), ("en", " \t.,"), (None, "É É É x"), ("", "a b")] * 3
    for i in range(n_docs):
        lang = rng.choice(["en", "de", None])
        words = [rng.choice("A b c d e f g hh ii é Ü 漢字 x y".split(" ")) if rng.random() < 0.8 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 80))]
        rows.append((lang, "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for w in words) + "new york city " * (i % 3)))
    return rows


@pytest.mark.parametrize("longest,options", [(3, {}), (3, {"sample": 5}), (3, {"sample": 1, "sample_least": 10**6}), (3, {"filter_bits": 64}), (4, {"sample": 12}), (2, {"sample": 7})])
def test_phrases(spark, longest, options):
    rows = corpus(random.Random(longest))
    docs = spark.createDataFrame(rows, "lang string, text string")
    docs = docs.select("*", F.lit("own").alias("phrase"), F.lit(1).alias("n"), F.lit(2).alias("length")).repartition(3)
    got = [tuple(r) for r in op11_phrases.phrases(docs, least=6, longest=longest, top=40, covered=50, **options).orderBy("lang", "rank").collect()]
    want = collocations(rows, 6, longest, 40, 50)
    assert got == want and len(want) > 60


def test_passes_close_the_border(spark):
    """Nothing proposed: every length takes a pass. All proposed: one pass is enough. Counts are the same."""
    rows = corpus(random.Random(8))
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    none, passes = op11_phrases.frequent_phrases(docs, 6, 3, sample_least=10**6)
    every, once = op11_phrases.frequent_phrases(docs, 6, 3, sample_least=1)
    assert (passes, once) == (3, 1)
    f, n = counted(rows, 6, 3)
    want = sorted([(lang, k, p, c) for (lang, k, p), c in f.items()] + [(lang, 0, "", c) for lang, c in n.items()])
    assert sorted(map(tuple, none.collect())) == want == sorted(map(tuple, every.collect()))


def test_phrases_of_an_empty_table_and_large_counts(spark):
    docs = spark.createDataFrame([("en", "x")], "lang string, text string")
    assert op11_phrases.phrases(docs.where("false")).count() == 0
    big = spark.range(1).select(F.lit(10**15).cast("decimal(18,0)").alias("aa"), (F.lit(10**15).cast("decimal(18,0)") * F.lit(10**15 + 1).cast("decimal(18,0)")).alias("lr"))
    assert big.select(F.expr("(aa * aa * 1000000) div lr")).first()[0] == 999999


def kept_lines(texts, least_docs, least_chars):
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r")) for line in (t or "").split("\n")] for t in texts]
    docs = Counter(k for own in keys for k in set(own) if len(k) >= least_chars)
    out = []
    for t, own in zip(texts, keys):
        lines = (t or "").split("\n")
        rest = [line for line, k in zip(lines, own) if docs[k] < least_docs]
        out.append((len(lines), len(lines) - len(rest), "\n".join(rest)))
    return out


@pytest.mark.parametrize("least_docs,least_chars,batches", [(10, 1, 4), (2, 1, 1), (3, 4, 7), (1, 2, 3)])
def test_lines(spark, least_docs, least_chars, batches):
    rng = random.Random(least_docs)
    lines = ["All rights reserved", " all RIGHTS reserved\t", "É", "é", "", "  \v", "x", " x", "ab\r", "long line of its own"] + [f"l{i}" for i in range(40)]
    texts = [None, "", "\n", "\n\n", "ab\n" * 5000, "\n".join(map(str, range(9000)))] + ["same\ntext\nagain"] * 12 + ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("*", *[F.lit("own").alias(c) for c in ("node", "key", "copies", "docs", "__gone_", "N_lines")]).repartition(3)
    out = op12_lines.dedup_lines(docs, least_docs=least_docs, least_chars=least_chars, batches=batches)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped", "kept_text"} - {"N_lines"}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == kept_lines(texts, least_docs, least_chars)
    assert op12_lines.dedup_lines(docs.where("false")).count() == 0


def test_runs_are_merged_by_level_and_settled_keys_stay_out(spark):
    runs = op12_lines.LineRuns(spark, least_docs=3, buckets=4)
    batch = lambda *keys: spark.createDataFrame([(b"n", k, 1) for k in keys], "node binary, key binary, copies bigint")
    sizes = []
    for i in range(7):
        runs.add(batch(b"hot", b"hot", b"hot", b"a", str(i).encode()))
        sizes.append([run.count() if run else None for run in runs.levels])
        if i == 0:
            assert runs.levels[0].where("key = X'686F74'").first().docs == 3
    # a binary counter of batches: 7 = 4 + 2 + 1; the hot key is settled by the first and in no later run
    assert [s is not None for s in sizes[-1]] == [True, True, True] and sizes[3] == [None, None, 6]
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        # a batch is shuffled once, to the buckets of the runs; runs are merged where they lie
        own = batch(b"a").groupBy("key").agg(F.sum("copies").alias("docs"))
        for keys in runs.settled():
            own = own.join(keys, "key", "left_anti")
        assert plan(own).count("Exchange hashpartitioning") == 1 and plan(own).count("Bucketed: true") == 3
        merged = plan(runs.both(runs.levels[2], runs.levels[1]))
        assert "Exchange" not in merged and merged.count("Bucketed: true") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert {bytes(r.key) for r in runs.close().collect()} == {b"hot", b"a"}


def plain_runs(w, exponent, least):
    """Runs by comparing the words with themselves, shifted by each period."""
    known = {}
    a = np.array([known.setdefault(x, len(known)) for x in w], np.int64)
    out, n = [], len(a)
    for q in range(1, n // exponent + 1):
        same = np.concatenate([[False], a[q:] == a[:-q], [False]])
        turn = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(turn[::2].tolist(), turn[1::2].tolist()):
            length = e - s + q
            if length >= max(least, exponent * q) and not any(q % p == 0 and (a[s : s + length - p] == a[s + p : s + length]).all() for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5), (2, 9)])
def test_runs_of_words(exponent, least):
    rng = random.Random(exponent * least)
    for _ in range(700):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 60)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w[a:] = [w[a + (i - a) % min(p, n - a)] for i in range(a, n)]
            w += [rng.randrange(k) for _ in range(rng.choice([0, 12]))]
        assert op13_periodic.runs_of(w, exponent, least) == plain_runs(w, exponent, least)


def test_every_square_is_found_where_it_ends():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(2) for _ in range(40)]
        finder = op13_periodic.SquareFinder()
        for i, x in enumerate(w):
            want = {q for q in range(1, (i + 1) // 2 + 1) if w[i - q + 1 : i + 1] == w[i - 2 * q + 1 : i - q + 1] and not any(q % p == 0 and w[i - 2 * q + 1 : i + 1 - p] == w[i - 2 * q + 1 + p : i + 1] for p in range(1, q))}
            got = finder.append(x)
            assert set(got) == want and len(got) == len(want)


def test_periodic_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic"](spark, SF).collect()
    assert len(rows) == len(docs) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w, 4, 6)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_periodic_on_odd_rows(spark):
    texts = [None, "", " \n\t", "one", "a " * 100_000, "x y " * 3, "x y " * 4, "É É " * 6, "a b c d\n" * 20 + "tail", "a b c d\n" * 20 + "tail"]
    rows = [(None if i == 3 else i % 9, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("own").alias("RUNS"), F.lit("own").alias("start"))
    out = sorted((str(r.text), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text, r.start) for r in op13_periodic.periodic_runs(docs).collect())
    one = {t: op13_periodic.words_of(None, t or "") for t in texts}
    assert len(out) == len(texts) and all(x[4] == "own" for x in out)
    for text, n, runs, rest, _ in out:
        w = one[None if text == "None" else text]
        want = plain_runs(w, 4, 6) if len(w) < 1000 else [(0, len(w), 1)]
        assert (n, runs) == (len(w), want)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert rest.encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)
    assert op13_periodic.periodic_runs(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        op13_periodic.periodic_runs(docs, exponent=1)
