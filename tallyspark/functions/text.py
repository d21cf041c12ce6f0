"""Text normalisation for descriptions and merchants."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Latin letters with marks, and without.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"
DEFAULT_CATEGORY = "Outros"


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Texts decomposed by Unicode's canonical mapping, without the marks that are left; null stays null. In Arrow batches, different texts once."""
    bare = {t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts.dropna().unique()}
    return texts.map(bare).astype(object)


def normalize(x: Column, unicode: bool = False) -> Column:
    """Trimmed, lower case, without accents, single spaces. The common Latin letters lose their marks by a table in the JVM; with
    unicode, all letters do by their decomposition, which takes Python workers."""
    bare = without_marks(F.lower(x)) if unicode else F.translate(F.lower(x), MARKED, PLAIN)
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def loose(x: Column) -> Column:
    """normalize, with all but letters and digits as spaces."""
    return F.trim(F.regexp_replace(normalize(x), r"[^a-z0-9]+", " "))


def merchant(x: Column) -> Column:
    """Upper case without accents, acquirers' prefixes and punctuation."""
    upper = F.upper(F.translate(F.trim(x), MARKED, PLAIN))
    bare = F.regexp_replace(upper, r"^(?:MP|PAG|PAYPAL|SUMUP|IZ|EC)\s*\*\s*", "")
    return F.trim(F.regexp_replace(bare, r"[^A-Z0-9]+", " "))


def compact(x: Column) -> Column:
    return F.replace(merchant(x), F.lit(" "), F.lit(""))


def description_key(x: Column) -> Column:
    """What recurring descriptions share: no digits, no com, br and www, single spaces."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[0-9]", ""), "[^a-zà-ú]+", " ")
    return F.array_join(F.filter(F.split(F.trim(letters), " "), lambda w: ~w.isin("com", "br", "www", "")), " ")


def category_or_default(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(DEFAULT_CATEGORY))


def is_uncategorized(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")).isin("", DEFAULT_CATEGORY, "Other")


def is_garbled(x: Column) -> Column:
    """Whether a merchant's name looks like a misread: tokens of five letters or more without a
    vowel, digits inside words, or hardly any letter. Some abbreviations are words of their own."""
    words = F.filter(F.split(loose(x), " "), lambda w: ~w.isin("ltda", "pgto", "mktplc", "brl"))
    odd = F.exists(words, lambda w: (F.length(w) >= 5) & ~w.rlike("[aeiouy]") | w.rlike("[a-z][0-9]+[a-z]"))
    letters = F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"\p{L}"))
    return F.coalesce(odd, F.lit(False)) | (letters < 2)


def needs_ocr(x: Column, least: int = 120) -> Column:
    """Too little text, too few letters and digits, or too many replacement characters."""
    text = F.coalesce(x, F.lit(""))
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    known = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return (solid < least) | (known < max(40, least // 2)) | (F.regexp_count(text, F.lit("�")) > 10)
