"""Queries: categorisation and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import classifying as C
from tallyspark.plans.registry import query

_FROM, _TO = T.MARKED, T.PLAIN
NORM = lambda x: f"trim(regexp_replace(translate(lower({x}), '{_FROM}', '{_TO}'), '\\s+', ' ', 'g'))"
LOOSE = lambda x: f"trim(regexp_replace({NORM(x)}, '[^a-z0-9]+', ' ', 'g'))"


@query("sf1_sf2_normalize", "docs", sql=f"SELECT doc_id, md5({NORM('text')}) AS normal, md5({LOOSE('text')}) AS loose FROM docs")
def _(docs):
    return docs.select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal"), F.md5(T.loose(F.col("text"))).alias("loose"))


@query("sf1_unicode", "docs", sql="SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'))) AS normal FROM docs")
def _(docs):
    return docs.select("doc_id", F.md5(T.normalize(F.col("text"), unicode=True)).alias("normal"))


@query("sf3_merchant", "docs", sql=f"""WITH m AS (SELECT doc_id, trim(regexp_replace(regexp_replace(upper(translate(trim(replace(text, 'ß', 's')), '{_FROM}', '{_TO}')), '^(?:MP|PAG|PAYPAL|SUMUP|IZ|EC)\\s*\\*\\s*', ''), '[^A-Z0-9]+', ' ', 'g')) AS merchant FROM docs)
SELECT doc_id, md5(merchant) AS merchant, length(replace(merchant, ' ', '')) AS n_compact FROM m""")
def _(docs):
    text = F.replace("text", F.lit("ß"), F.lit("s"))  # engines differ in its upper case
    return docs.select("doc_id", F.md5(T.merchant(text)).alias("merchant"), F.length(T.compact(text)).cast("bigint").alias("n_compact"))


@query("sf4_description_key", "tx", sql="SELECT DISTINCT description, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(description)), '[0-9]', '', 'g'), '[^a-zà-ú]+', ' ', 'g'), '\\b(com|br|www)\\b ?', '', 'g')) AS key FROM tx")
def _(tx):
    return tx.select("description").distinct().withColumn("key", T.description_key(F.col("description")))


@query("sf14_garbled", "docs", sql=f"""WITH w AS (SELECT doc_id, string_split({LOOSE('text')}, ' ') AS ws, text FROM docs)
SELECT doc_id, len(list_filter(ws, lambda x: x NOT IN ('ltda', 'pgto', 'mktplc', 'brl') AND (len(x) >= 5 AND NOT regexp_matches(x, '[aeiouy]') OR regexp_matches(x, '[a-z][0-9]+[a-z]')))) > 0 OR len(regexp_extract_all(text, '\\pL')) < 2 AS garbled FROM w""")
def _(docs):
    return docs.select("doc_id", T.is_garbled(F.col("text")).alias("garbled"))


@query("sf22_needs_ocr", "docs", sql="SELECT doc_id, len(regexp_replace(text, '[\\s\\v]', '', 'g')) < 120 OR len(regexp_extract_all(text, '[\\pL\\pN]')) < 60 OR len(regexp_extract_all(text, '�')) > 10 AS needs_ocr FROM docs")
def _(docs):
    return docs.select("doc_id", T.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("flt6_uncategorized", "tx", sql="SELECT tx_id FROM tx WHERE coalesce(trim(category), '') IN ('', 'Outros', 'Other')")
def _(tx):
    return C.uncategorized(tx).select("tx_id")


@query("sf7_labels_and_scope", "tx", sql="""SELECT DISTINCT description, category, CASE lower(trim(category)) WHEN 'economy' THEN 'Economia' WHEN 'promo' THEN 'Promoção' ELSE trim(category) END AS label,
  CASE WHEN regexp_matches(lower(concat_ws(' ', description, category)), '\\b(cnpj|mei|empresa|business|office|promo)\\b') THEN 'BUSINESS' ELSE 'PERSONAL' END AS inferred FROM tx""")
def _(tx):
    return tx.select("description", "category").distinct().withColumn("label", C.category_label(F.col("category"))).withColumn("inferred", C.infer_scope(F.col("description"), F.col("category")))


@query("sf7_label_table", "tx", sql="SELECT DISTINCT category, CASE WHEN contains(lower(category), 'small') OR contains(lower(category), 'econ') THEN 'First' WHEN contains(lower(category), 'brush') THEN 'Second' WHEN contains(lower(category), 'econ') OR contains(lower(category), 'plat') THEN 'Third' WHEN coalesce(trim(category), '') = '' THEN 'Outros' ELSE category END AS label FROM tx")
def _(tx):
    labels = tx.sparkSession.createDataFrame([(0, ["small", "econ"], "First"), (1, ["brush"], "Second"), (2, ["econ", "plat"], "Third")], "ordinal int, patterns array<string>, label string")
    return C.category_labels(tx.select("category").distinct(), labels)


_RULES = """WITH r AS (SELECT tx_id, r.category AS c, row_number() OVER (PARTITION BY tx_id, t.person_id ORDER BY priority DESC, created_at DESC, pattern DESC, r.category DESC) AS k FROM tx t JOIN rules r ON r.user_id = t.person_id AND contains(lower(description), pattern)), rule AS (SELECT tx_id, c FROM r WHERE k = 1)
"""


@query("jn4_by_rules", "tx", "rules", sql=_RULES + "SELECT t.tx_id, c AS rule_category FROM tx t LEFT JOIN rule ON rule.tx_id = t.tx_id")
def _(tx, rules):
    return C.by_rules(tx, rules).select("tx_id", "rule_category")


_FEED = """h AS (SELECT f.user_id AS person_id, lower(t.description) AS past, chosen_category, f.created_at FROM feedback f JOIN tx t ON t.tx_id = f.transaction_id),
w AS (SELECT DISTINCT person_id, description, substr(lower(trim(description)), 1, 80) AS target FROM tx),
p AS (SELECT w.person_id, description, chosen_category, created_at, row_number() OVER (PARTITION BY w.person_id, description ORDER BY created_at DESC, chosen_category, past) AS k FROM w JOIN h ON h.person_id = w.person_id AND contains(past, target)),
v AS (SELECT person_id, description, chosen_category, count(*) AS n, max(created_at) AS last FROM p WHERE k <= 50 GROUP BY ALL),
fb AS (SELECT person_id, description, chosen_category AS feedback_category, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY person_id, description ORDER BY n DESC, last DESC, chosen_category) = 1)
"""


@query("jn5_by_feedback", "tx", "feedback", sql="WITH " + _FEED + "SELECT person_id, description, feedback_category, CAST(votes AS BIGINT) AS votes FROM fb")
def _(tx, feedback):
    return C.by_feedback(tx, feedback, tx)


_MERCH = """m AS (SELECT d.description, x.category, CAST(x.confidence AS DOUBLE) AS confidence, row_number() OVER (PARTITION BY d.description ORDER BY x.confidence DESC, length(replace(pattern, '|', '')) DESC, ordinal) AS k
  FROM (SELECT DISTINCT description FROM tx) d JOIN dictionary x ON len(list_filter(string_split(x.pattern, '|'), lambda p: NOT CASE WHEN length(p) <= 3 THEN contains(' ' || lower(d.description) || ' ', ' ' || p || ' ') ELSE contains(lower(d.description), p) END)) = 0),
merch AS (SELECT description, category, confidence FROM m WHERE k = 1)
"""
_WORDS = """kw AS (SELECT d.description, category, CAST(sum(weight) AS DOUBLE) AS score, string_agg(keyword, ',' ORDER BY keyword) AS words FROM (SELECT DISTINCT description FROM tx) d JOIN keywords k ON contains(lower(d.description), keyword) GROUP BY ALL),
words AS (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY description ORDER BY score DESC, category) = 1)
"""


@query("jn6_by_merchant", "tx", "dictionary", sql="WITH " + _MERCH + "SELECT * FROM merch")
def _(tx, dictionary):
    found = C.by_merchant(tx.select("description").distinct(), dictionary).where("merchant is not null")
    return found.select("description", F.col("merchant.category").alias("category"), F.col("merchant.confidence").alias("confidence"))


@query("sf5_by_keywords", "tx", "keywords", sql="WITH " + _WORDS + "SELECT * FROM words")
def _(tx, keywords):
    return C.by_keywords(tx.select("description").distinct(), keywords).where("keyword is not null").select("description", "keyword.category", "keyword.score", "keyword.words")


@query("cl1_sf13_classify", "tx", "rules", "feedback", "dictionary", "keywords", sql=_RULES + ", " + _FEED + ", " + _MERCH + ", " + _WORDS + """SELECT t.tx_id, t.person_id, coalesce(rule.c, feedback_category, merch.category, words.category, 'Outros') AS category,
  CAST(CASE WHEN rule.c IS NOT NULL THEN 0.92 WHEN feedback_category IS NOT NULL THEN 0.90 WHEN merch.category IS NOT NULL THEN merch.confidence WHEN words.category IS NOT NULL THEN CASE WHEN score >= 3 THEN 0.85 WHEN score >= 2 THEN 0.75 WHEN score >= 1 THEN 0.65 ELSE 0.55 END ELSE 0.50 END AS DOUBLE) AS confidence,
  CASE WHEN rule.c IS NOT NULL THEN 'rule' WHEN feedback_category IS NOT NULL THEN 'feedback' WHEN merch.category IS NOT NULL THEN 'merchant' WHEN words.category IS NOT NULL THEN 'keywords:' || words.words ELSE 'default' END AS reason, t.type
FROM tx t LEFT JOIN rule ON rule.tx_id = t.tx_id LEFT JOIN fb ON fb.person_id = t.person_id AND fb.description = t.description LEFT JOIN merch ON merch.description = t.description LEFT JOIN words ON words.description = t.description
WHERE coalesce(trim(t.category), '') IN ('', 'Outros', 'Other')""")
def _(tx, rules, feedback, dictionary, keywords):
    return C.classify(C.uncategorized(tx), rules, feedback, tx, dictionary, keywords)


@query("sf6_ordered_rules", "tx", sql="""SELECT DISTINCT description, type, CASE WHEN type = 'INCOME' AND (contains(description, 'gear') OR contains(description, 'ring')) THEN 'Salary' WHEN contains(description, 'gear') THEN 'Tools' WHEN contains(description, 'bolt') OR contains(description, 'cog') THEN 'Repair' ELSE 'Outros' END AS rule_category FROM tx""")
def _(tx):
    rules = tx.sparkSession.createDataFrame([(0, "INCOME", ["gear", "ring"], "Salary"), (1, None, ["gear"], "Tools"), (2, None, ["bolt", "cog"], "Repair")], "ordinal int, type string, patterns array<string>, category string")
    return C.ordered_rule(tx.select("description", "type").distinct(), rules)
