"""Categorisation: user rules, feedback, a merchant dictionary, keywords, and ordered rules.

Dictionaries are tables that the user supplies, of any size. Merchants, keywords and ordered rules are indexed by their
rarest run of characters, so that a text meets only patterns that share one; Spark broadcasts an index that is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.shared import saved
from tallyspark.functions.text import DEFAULT_CATEGORY, is_uncategorized, loose, normalize

def matches_loosely(text: Column, pattern: Column) -> Column:
    """All |-separated parts occur; those of three letters or fewer at the bounds of a word."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.forall(F.split(pattern, r"\|"), lambda p: F.when(F.length(p) <= 3, padded.contains(F.concat(F.lit(" "), p, F.lit(" ")))).otherwise(text.contains(p)))


def by_rules(tx: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_category: the user's first rule, by priority and then age (newest first), whose pattern the description holds."""
    ordered = rules.groupBy(F.col("user_id").alias("person_id")).agg(F.sort_array(F.collect_list(F.struct("priority", "created_at", "pattern", "category")), asc=False).alias("rules"))
    hit = F.filter("rules", lambda r: (normalize(r["pattern"]) != "") & normalize(F.col("description")).contains(normalize(r["pattern"])))
    return tx.join(ordered, "person_id", "left").withColumn("rule_category", F.get(hit, F.lit(0))["category"]).drop("rules")


def _runs(x: Column, n: int = 4) -> Column:
    """The different runs of n characters of a text; none of a shorter one."""
    return F.when(F.length(x) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))))


def _held_by(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """wanted (person_id, target) joined to the person's history whose past description contains the target.

    A target is the beginning of a suffix of each description that contains it. Of past descriptions, the suffixes that begin with
    the first four characters of some target are sorted, by person and those characters, among the targets: the targets that a suffix begins with
    are the last one at or before it and those that this one begins with, as far as they fit. So a suffix meets no more targets than it has
    beginnings, however common its words are. Targets of three characters or fewer meet the runs of their length.
    """
    who, c = "person_id", F.col
    past, targets = history.select(who, "past").distinct(), wanted.select(who, "target").distinct()
    long = targets.where(F.length("target") >= 4).withColumn("head", F.substring("target", 1, 4))
    places = past.where(F.length("past") >= 4).select(who, "past", F.explode(F.sequence(F.lit(1), F.length("past") - 3)).alias("i")).withColumn("head", F.substr("past", "i", F.lit(4)))
    starts = places.join(long.select(who, "head").distinct(), [who, "head"], "left_semi").select(who, "head", F.substr("past", "i").alias("text"), "past")
    both = starts.withColumn("target", F.lit(None).cast("string")).unionByName(long.select(who, "head", c("target").alias("text"), F.lit(None).cast("string").alias("past"), "target"))
    order = Window.partitionBy(who, "head").orderBy("text", F.asc_nulls_first("past")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("last", F.last("target", ignorenulls=True).over(order)).where("past is not null and last is not null")
    # of each target the targets that it begins with: itself and at most one for each of its beginnings
    begins = long.select(who, c("target").alias("last"), F.explode(F.transform(F.sequence(F.lit(4), F.length("target")), lambda n: F.substr("target", F.lit(1), n))).alias("target"))
    chains = begins.join(long.select(who, "target"), [who, "target"], "left_semi").groupBy(who, "last").agg(F.collect_list("target").alias("chain"))
    found = near.join(chains, [who, "last"]).select(who, "past", F.explode(F.filter("chain", lambda t: F.startswith("text", t))).alias("target")).distinct()
    few = targets.where(F.length("target") < 4)
    runs = past.join(few.select(who).distinct(), who, "left_semi").select(who, "past", F.explode(F.concat(*[_runs(c("past"), n) for n in (1, 2, 3)])).alias("target"))
    found = found.select(who, "target", "past").unionByName(runs.join(few, [who, "target"]).select(who, "target", "past"))
    return wanted.join(found, [who, "target"]).join(history, [who, "past"])


def by_feedback(tx: DataFrame, feedback: DataFrame, past: DataFrame, newest: int = 50, most: int = 64) -> DataFrame:
    """(person, description, feedback_category) for the distinct descriptions of tx: of the newest 50 choices
    whose past description contains the description's first 80 characters, the most frequent; ties: the newest.

    Choices are first summed by (person, past description, category, day), so that a heavy user's repeats meet as one. Where a user's
    pairs of descriptions and choices are at most `most` for each of them, all pairs are tried; other users' meet by _held_by.
    """
    history = feedback.join(past.select(F.col("tx_id").alias("transaction_id"), F.lower("description").alias("past")), "transaction_id")
    history = history.groupBy(F.col("user_id").alias("person_id"), "past", "chosen_category", "created_at").agg(F.count("*").alias("times"))
    target = F.substring(normalize(F.col("description")), 1, 80)
    # both are read several times; written, neither is derived again
    texts = saved(tx.select("person_id", "description").distinct(), "feedback-targets")
    history = saved(history, "feedback-history")
    sizes = texts.groupBy("person_id").agg(F.count("*").alias("t")).join(history.groupBy("person_id").agg(F.count("*").alias("h")), "person_id")
    heavy = saved(sizes.where(F.col("t") * F.col("h") > most * (F.col("t") + F.col("h"))).select("person_id"), "feedback-heavy")
    wanted = texts.withColumn("target", target).where("target <> ''")
    direct, rest = texts, history
    if not heavy.isEmpty():
        direct, rest = (df.join(heavy, "person_id", "left_anti") for df in (texts, history))
    # the target is put together after the join, which carries the description once
    pairs = direct.join(rest, "person_id").withColumn("target", target).where("target <> '' and contains(past, target)")
    if not heavy.isEmpty():
        pairs = pairs.unionByName(_held_by(*(df.join(heavy, "person_id", "left_semi") for df in (wanted, history))))
    recent = Window.partitionBy("person_id", "description").orderBy(F.desc("created_at"), "chosen_category", "past")
    ranked = pairs.withColumn("upto", F.sum("times").over(recent.rowsBetween(Window.unboundedPreceding, 0))).withColumn("counted", F.greatest(F.lit(0), F.least("times", F.lit(newest) - F.col("upto") + F.col("times"))))
    votes = ranked.where("counted > 0").groupBy("person_id", "description", "chosen_category").agg(F.sum("counted").alias("n"), F.max("created_at").alias("last"))
    best = Window.partitionBy("person_id", "description").orderBy(F.desc("n"), F.desc("last"), "chosen_category")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("person_id", "description", F.col("chosen_category").alias("feedback_category"), F.col("n").alias("votes"))


def _candidates(texts: DataFrame, text: Column, entries: DataFrame, pattern: str, literal: Column) -> DataFrame:
    """Each different description with text, joined to the entries that it may hold: those whose literal's rarest run of four
    characters (all of a shorter literal) it has, once each. The rarest is that of the fewest patterns, so that a run of a text
    stands for few of them. An empty literal is in all texts, a null one in none. Entries may be as many as one likes: the join is by run, and
    a text gives runs of only those lengths that literals have."""
    runs = entries.select(pattern, F.explode(F.when(F.length(literal) < 4, F.array(literal)).otherwise(_runs(literal))).alias("run")).distinct()
    rarest = runs.join(runs.groupBy("run").agg(F.count("*").alias("n")), "run").groupBy(pattern).agg(F.min(F.struct("n", "run")).alias("e"))
    index = entries.join(rarest.select(pattern, "e.run"), pattern)  # a row an entry at most
    lengths = [r[0] for r in entries.select(F.least(F.length(literal), F.lit(4)).alias("n")).where("n is not null").distinct().collect()]  # five at most
    keys = F.concat(F.array().cast("array<string>"), *[_runs(F.col("text"), n) if n else F.array(F.lit("")) for n in lengths])
    own = texts.select("description").distinct().withColumn("text", text)
    return own.withColumn("run", F.explode(keys)).join(index, "run").drop("run")


def by_merchant(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """merchant: the entry (category, confidence) of all that match, by confidence, then length, then order in the dictionary."""
    entries = dictionary.select("ordinal", "pattern", "category", F.col("confidence").cast("double").alias("confidence"))
    parts = F.transform(F.split("pattern", r"\|"), lambda p: F.struct(F.length(p).alias("n"), F.when(F.length(p) <= 3, F.concat(F.lit(" "), p, F.lit(" "))).otherwise(p).alias("p")))
    padded = F.concat(F.lit(" "), loose(F.col("description")), F.lit(" "))
    met = _candidates(texts, padded, entries, "pattern", F.array_max(parts)["p"])
    hit = met.where(matches_loosely(F.substring("text", F.lit(2), F.length("text") - 2), F.col("pattern")))
    length = F.length(F.replace("pattern", F.lit("|"), F.lit("")))
    best = hit.groupBy("description").agg(F.max(F.struct("confidence", length.alias("length"), (-F.col("ordinal")).alias("order"), "category")).alias("merchant"))
    return texts.join(best, "description", "left")


def by_keywords(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """keyword: the category with the largest sum of the weights of the words it holds (ties by name), and the words."""
    entries = keywords.select("category", "keyword", F.col("weight").cast("double").alias("weight"))
    met = _candidates(texts, normalize(F.col("description")), entries, "keyword", F.col("keyword")).where(F.col("text").contains(F.col("keyword")))
    # sorted before they are added up, so that the sum doesn't hang on their order
    hits = met.groupBy("description", "category").agg(F.array_sort(F.collect_list(F.struct("keyword", "weight"))).alias("hits"))
    score = F.aggregate("hits", F.lit(0.0), lambda a, w: a + w["weight"])
    scored = hits.select("description", "category", score.alias("score"), F.array_join(F.transform("hits", lambda w: w["keyword"]), ",").alias("words")).where("score > 0")
    best = scored.groupBy("description").agg(F.min(F.struct((-F.col("score")).alias("down"), "category", "score", "words")).alias("b"))
    return texts.join(best.select("description", F.struct("b.score", "b.category", "b.words").alias("keyword")), "description", "left")


def confidence_of(score: Column) -> Column:
    return F.when(score >= 3, 0.85).when(score >= 2, 0.75).when(score >= 1, 0.65).otherwise(0.55)


def classify(tx: DataFrame, rules: DataFrame, feedback: DataFrame, past: DataFrame, dictionary: DataFrame, keywords: DataFrame) -> DataFrame:
    """tx_id with category, confidence, reason and type: rule, feedback, merchant, keywords, default.

    Merchants and keywords see distinct descriptions only. Type: INCOME where the amount is negative, unless given.
    """
    kind = F.coalesce("type", F.when(F.col("amount") < 0, "INCOME").otherwise("EXPENSE"))
    rows = tx.select("tx_id", "person_id", "description", "amount", "type")
    return categories(rows, rules, feedback, past, dictionary, keywords).select("tx_id", "person_id", "category", "confidence", "reason", kind.alias("type"))


def categories(tx: DataFrame, rules: DataFrame, feedback: DataFrame, past: DataFrame, dictionary: DataFrame, keywords: DataFrame) -> DataFrame:
    """tx (person_id, description) with category, confidence and reason, as classify finds them."""
    texts = by_keywords(by_merchant(tx.select("description").distinct(), dictionary), keywords)
    rows = by_rules(tx, rules).join(by_feedback(tx, feedback, past), ["person_id", "description"], "left").join(texts, "description", "left")
    col = F.col
    reason = F.when(col("rule_category").isNotNull(), "rule").when(col("feedback_category").isNotNull(), "feedback").when(col("merchant").isNotNull(), "merchant").when(col("keyword").isNotNull(), F.concat(F.lit("keywords:"), col("keyword.words"))).otherwise("default")
    category = F.coalesce("rule_category", "feedback_category", "merchant.category", "keyword.category", F.lit(DEFAULT_CATEGORY))
    confidence = F.when(col("rule_category").isNotNull(), 0.92).when(col("feedback_category").isNotNull(), 0.90).when(col("merchant").isNotNull(), col("merchant.confidence")).when(col("keyword").isNotNull(), confidence_of(col("keyword.score"))).otherwise(0.50)
    return rows.select(*tx.columns, category.alias("category"), confidence.cast("double").alias("confidence"), reason.alias("reason"))


def ordered_rule(texts: DataFrame, rules: DataFrame, default: str = DEFAULT_CATEGORY) -> DataFrame:
    """rule_category: that of the first rule (ordinal, type or null for any, patterns, category) of which any pattern occurs, else the
    default. Rules may be as many as one likes: descriptions look their patterns up, and the smallest ordinal that fits a row's type wins."""
    patterns = rules.select("ordinal", F.col("type").alias("rule_type"), "category", F.explode("patterns").alias("pattern"))
    entries = patterns.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rule_type", "category"))).alias("rules"))
    met = _candidates(texts, loose(F.col("description")), entries, "pattern", F.col("pattern")).where(F.col("text").contains(F.col("pattern")))
    hits = met.select("description", F.explode("rules").alias("r")).groupBy("description", "r.rule_type").agg(F.min(F.struct("r.ordinal", "r.category")).alias("first"))
    by_type = hits.groupBy("description").agg(F.min(F.when(F.col("rule_type").isNull(), F.col("first"))).alias("any"), F.map_from_entries(F.collect_list(F.when(F.col("rule_type").isNotNull(), F.struct("rule_type", "first")))).alias("own"))
    fits = F.least(F.col("any"), F.try_element_at("own", "type"))
    return texts.join(by_type, "description", "left").withColumn("rule_category", F.coalesce(fits["category"], F.lit(default))).drop("any", "own")


def word_kinds(rows: DataFrame, words: DataFrame, column: str = "description") -> DataFrame:
    """rows with kinds, those of the words (kind, pattern) that a text holds as parts, sorted. Words may be as many as one likes."""
    entries = words.groupBy("pattern").agg(F.collect_set("kind").alias("of"))
    texts = rows.select(F.col(column).alias("description"))
    met = _candidates(texts, normalize(F.col("description")), entries, "pattern", F.col("pattern")).where(F.col("text").contains(F.col("pattern")))
    kinds = met.select(F.col("description").alias("__text"), F.explode("of").alias("kind")).groupBy("__text").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    joined = rows.join(kinds, F.col(column) == F.col("__text"), "left").drop("__text")
    return joined.withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def uncategorized(tx: DataFrame) -> DataFrame:
    return tx.where(is_uncategorized(F.col("category")))


def infer_scope(description: Column, category: Column) -> Column:
    """BUSINESS where business words occur, else PERSONAL."""
    return F.when(loose(F.concat_ws(" ", description, category)).rlike(r"\b(cnpj|mei|empresa|business|office|promo)\b"), "BUSINESS").otherwise("PERSONAL")


def category_label(x: Column) -> Column:
    """One label for Portuguese and English synonyms, of our own few; others as they are, trimmed. A whole list is a table for category_labels."""
    n = normalize(x)
    return F.when(n.isin("food", "alimentacao", "comida"), "Alimentação").when(n.isin("transport", "transporte"), "Transporte").when(n.isin("economy", "economia"), "Economia").when(n.isin("promo", "promocao"), "Promoção").otherwise(F.trim(x))


def category_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (category) with label: that of the first of the labels (ordinal, patterns, label) of which a pattern is part of the category; a missing
    category and the default's synonyms are the default, others stay as they are."""
    rules = labels.select("ordinal", F.lit(None).cast("string").alias("type"), "patterns", F.col("label").alias("category"))
    names = rows.select(F.col("category").alias("description")).where("description is not null").distinct().withColumn("type", F.lit(None).cast("string"))
    found = ordered_rule(names, rules, "").select(F.col("description").alias("__name"), F.nullif("rule_category", F.lit("")).alias("label"))
    same = F.when(normalize(F.coalesce("category", F.lit(""))).isin("", "other", "outros"), DEFAULT_CATEGORY).otherwise(F.col("category"))
    return rows.join(found, F.col("category") == F.col("__name"), "left").drop("__name").withColumn("label", F.coalesce("label", same))
