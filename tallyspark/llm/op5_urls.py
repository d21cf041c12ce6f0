"""URL rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over `host/path`, with the literals that any match holds: `spam` where it is a
whole token in each match, `casino*`, `*casino` or `*casino*` where other letters or digits may follow or go
before. A whole token is its own key, the others have their runs of GRAM characters. Of a rule's keys, the one
that fewest of the given URLs hold is its index entry. Each distinct URL looks up its tokens and their
runs, and only the rules found there run their expression. Rules without a key are tried on every URL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table, without

# The host and path rules of the query's contract.
LISTED = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Pattern rules for URLs that no listed rule fits: (verdict, expression, literal tokens).
PATTERNS = [
    ("block", r"(^|[./-])spam([./-]|$)", ["spam"]),
    ("block", r"(^|[./-])cheap-(pills|watches|loans)([./-]|$)", ["cheap"]),
    ("block", r"(^|[./-])free-(bets|spins|money)([./-]|$)", ["free"]),
    ("block", r"(^|[./-])(online-)?casino[^/]*/", ["casino*"]),
    ("block", r"(^|[./-])poker([./-]|$)", ["poker"]),
    ("block", r"(^|[./-])adult-(video|chat)([./-]|$)", ["adult"]),
    ("block", r"(^|[./-])payday-loans?([./-]|$)", ["payday"]),
    ("block", r"(^|[./-])link-farm([./-]|$)", ["link", "farm"]),
    ("block", r"/wp-login\.php$", ["wp", "login", "php"]),
    ("block", r"/search/results?/", ["search"]),
    ("allow", r"(^|\.)wikipedia\.org/wiki/", ["wikipedia", "org", "wiki"]),
    ("block", r"^(\d{1,3}\.){3}\d{1,3}/", []),
]
#: Above this many rules the index isn't broadcast but joined by shuffle.
BROADCAST_RULES = 100_000
GRAM = 4
OUT = ["host", "path", "rule", "verdict"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the
    end. Both are empty where url is null or holds no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), capitals, small)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, listed=LISTED, patterns=PATTERNS) -> DataFrame:
    """Rules as a table: (rule, pattern, tokens, verdict, priority). Rule text is null for patterns,
    which only decide where no listed rule does; the longest listed rule wins, then block."""
    rows = []
    for verdict, rule in listed:
        host, _, path = rule.partition("/")
        rows.append((rule, rf"(?s)^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", re.findall(r"[a-z0-9]+", host + "/" + path if path.endswith("/") else host), verdict, len(rule)))
    for n, (verdict, pattern, tokens) in enumerate(patterns):
        rows.append((None, "(?s)" + pattern, tokens, verdict, -1 - n))
    return spark.createDataFrame(rows, "rule string, pattern string, tokens array<string>, verdict string, priority int")


def _grams(token: Column) -> Column:
    """The runs of GRAM characters of a token, marked so that they aren't taken for tokens."""
    return F.when(F.length(token) < GRAM, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(token) - GRAM + 1), lambda i: F.concat(F.lit("~"), F.substring(token, i, F.lit(GRAM)))))


def _keys(literals: Column) -> Column:
    """The index keys of a rule: whole tokens, and the runs of literals with open ends."""
    open_ = lambda t: t.contains("*")
    return F.array_distinct(F.concat(F.filter(literals, lambda t: ~open_(t)), F.flatten(F.transform(F.filter(literals, open_), lambda t: _grams(F.replace(t, F.lit("*"), F.lit("")))))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages, row for row, with host, path, the listed rule that decided (else null) and the verdict.

    Where no listed rule fits, the first fitting pattern gives the verdict, and where none does,
    `default`. Null urls, and such without ://, have an empty host and path. Columns of pages named
    like a new one are replaced. Tokens are the runs of a-z and 0-9 of host and path, case ignored. Equal URLs
    have equal verdicts; an empty table gives an empty result.
    """
    rules = rules.withColumn("tokens", _keys(F.coalesce("tokens", F.array().cast("array<string>"))))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    sized = F.broadcast if small else (lambda df: df)
    urls = pages.select(F.col(f"`{url}`").cast("string").alias("__url")).distinct()
    host, path = host_path(F.col("__url"))
    urls = urls.select("__url", host.alias("host"), path.alias("path")).withColumn("at", F.concat("host", "path"))
    tokens = F.array_distinct(F.filter(F.split(F.lower("at"), r"[^a-z0-9]+"), lambda t: t != ""))
    runs = not rules.where(F.exists("tokens", lambda t: t.startswith("~"))).isEmpty()
    keys = F.concat(tokens, F.array_distinct(F.flatten(F.transform(tokens, _grams)))) if runs else tokens
    lists = urls.select("__url", "at", F.explode(F.array_append(keys, F.lit("*"))).alias("token"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = lists.join(sized(wanted), "token", "left_semi").groupBy("token").count()
    # the rarest token of each rule; one that no URL holds is rarest of all
    entries = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("*")))).alias("token"))
    entries = entries.join(held, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    index = entries.groupBy("pattern", "verdict", "priority", F.coalesce("rule", F.lit("")).alias("rule")).agg(F.min(F.struct("count", "token")).alias("e"))
    index = index.select(F.col("e.token").alias("token"), "pattern", "verdict", "priority", "rule")
    fits = lists.join(sized(index), "token").where(F.expr("at rlike pattern"))
    order = F.struct("priority", (F.col("verdict") == "block").alias("b"), "rule", "verdict")
    best = fits.groupBy("__url").agg(F.max(order).alias("best"))
    judged = urls.join(best, "__url", "left").select(
        F.col("__url").alias("__key"), "host", "path",
        F.when(F.col("best.rule") != "", F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
    kept = without(pages, [c for c in OUT if c != url])
    return kept.join(judged, F.col(f"`{url}`").cast("string").eqNullSafe(F.col("__key")), "left").drop("__key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", *OUT)


def _case() -> str:
    def fit(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    ordered = sorted(LISTED, key=lambda x: (-len(x[1]), x[1]))
    rule = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{r}'" for _, r in ordered) + " END"
    given = "CASE " + " ".join(f"WHEN {fit(r)} THEN '{v}'" for v, r in ordered) + " " + " ".join(f"WHEN regexp_matches(whole, '{p}') THEN '{v}'" for v, p, _ in PATTERNS) + " ELSE 'allow' END"
    return f"{rule} AS rule, {given} AS verdict"


SQL = f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
joined AS (SELECT *, host || path AS whole FROM parts)
SELECT page_id, host, path, {_case()} FROM joined
"""
