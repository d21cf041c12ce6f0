"""Phrases mined by Toivonen's sampling, with an exact count of all that can be frequent.

A bounded sample proposes the words and phrases that it holds twice. A pass over all documents counts all words, and of longer
phrases those whose two parts, less the last and less the first word, are known: they are proposed or on the
negative border. A counted phrase that is frequent without having been known is a failure of the border: it becomes
known, and another pass counts the phrases that have become countable by it, and only those. Passes end when
no failure is left. Every frequent phrase has frequent parts, so at the end all of them are counted, each in one pass.

What is known is told by two bit sets of fixed size a length, the present one and that of the pass before. A phrase that is taken for
known by chance is counted for nothing; none is missed. So their size bounds the broadcast, not the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, saved, slices, table, texts_of
from tallyspark.llm.words import U, mix

LEAST, LONGEST, TOP = 10, 3, 2000
#: A candidate goes if a longer one has at least this part of its occurrences, in percent.
COVERED = 50
#: The sample: so many different texts, those first by hash, of up to so many characters; phrases that it holds so often are proposed.
SAMPLE, SAMPLE_CHARS, SAMPLE_LEAST = 2000, 20_000, 2
#: Parts of a language that are ranked first.
PARTS = 16
#: Bits of the set of known phrases of one length.
FILTER_BITS = 1 << 25
#: Words that a task counts together before it hands on their counts.
FLUSH = 1_000_000

_SEPARATORS = bytes.maketrans(b".,;:!?\n\v\f\r", b"." * 10)


def words_and_ends(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case, and b"." wherever a piece ends; words hold no dot."""
    # what the translation leaves of the characters that split() knows are the blank and the tab
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).replace(b".", b" . ").split()


class Known:
    """Bit sets of known phrases, one for each length: None knows all, and a length that has none knows nothing."""

    PROBES = 3

    def __init__(self, bits: int, sets: dict[int, np.ndarray] | None) -> None:
        self.bits, self.sets = bits, sets

    def places(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            step = mix(hashes + U(0x9E3779B97F4A7C15)) | U(1)
            return np.stack([(hashes + U(j) * step) & U(self.bits - 1) for j in range(self.PROBES)])

    def has(self, length: int, hashes: np.ndarray) -> np.ndarray:
        if self.sets is None:
            return np.ones(len(hashes), bool)
        if length not in self.sets:
            return np.zeros(len(hashes), bool)
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            out &= (self.sets[length][place >> U(6)] >> (place & U(63))) & U(1) == 1
        return out


class _Ids(dict):
    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _hash_words(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), U, len(words))


def _hash_longer(parts: np.ndarray, last: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(parts * U(0xC2B2AE3D27D4EB4F) + last)


def counted(words: list[bytes], ids: np.ndarray, lang: str, longest: int, new: Known, old: Known, first: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, their numbers) of the phrases that new makes countable and old didn't, by length. ids are words by
    their numbers, 0 where a piece ends. The first pass has all words, and as length 0 their number."""
    spelt = pa.array(words, pa.binary()).cast(pa.string())
    times = np.bincount(ids, minlength=len(words))
    times[0] = 0
    if first:
        yield 0, pa.array([""]), np.array([times.sum()])
        there = np.flatnonzero(times)
        yield 1, spelt.take(pa.array(there)), times[there]
    own = _hash_words(words, _seed(lang))
    # of each place: the hash of the phrase one shorter that begins there, and whether it is known now and was before
    word = ids > 0
    h, is_new, was = own[ids], word & new.has(1, own)[ids], word & old.has(1, own)[ids]
    for length in range(2, longest + 1):
        places = np.flatnonzero(is_new[:-1] & is_new[1:])
        if not len(places):
            return
        fresh = places[~(was[places] & was[places + 1])]
        if len(fresh):
            parts, n = _distinct(ids, fresh, length)
            yield length, pc.binary_join_element_wise(*(spelt.take(pa.array(c)) for c in parts), " "), n
        if length < longest:
            longer = _hash_longer(h[places], own[ids[places + length - 1]])
            h, is_new, was = np.zeros(len(h) - 1, U), np.zeros(len(h) - 1, bool), np.zeros(len(h) - 1, bool)
            h[places], is_new[places], was[places] = longer, new.has(length, longer), old.has(length, longer)


def _distinct(ids: np.ndarray, places: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different runs of `length` ids that begin at the places, as a list of columns, and how often each does."""
    code, columns = ids[places].astype(U), None
    for j in range(1, length):
        if j > 1:
            kinds, code = np.unique(code, return_inverse=True)
            columns = _columns(kinds, columns)
        code = (code.astype(U) << U(32)) | ids[places + j].astype(U)
    kinds, n = np.unique(code, return_counts=True)
    return _columns(kinds, columns), n


def _columns(kinds: np.ndarray, heads: list[np.ndarray] | None) -> list[np.ndarray]:
    head, last = (kinds >> U(32)).astype(np.int64), (kinds & U(0xFFFFFFFF)).astype(np.int64)
    return [head, last] if heads is None else [*(c[head] for c in heads), last]


def counts(docs: DataFrame, longest: int, new: Known, old: Known, first: bool) -> DataFrame:
    """(lang, length, phrase, n) of docs (lang, text): what each task counts, summed."""
    names, types = ["lang", "length", "phrase", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()]
    shared = docs.sparkSession.sparkContext.broadcast((new, old))  # a few bit sets of fixed size

    def run(batches):
        ids: dict[str, _Ids] = {}
        texts: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, known in ids.items():
                for length, phrases, n in counted(known.words, np.concatenate(texts[lang]), lang, longest, *shared.value, first):
                    for i in range(0, len(phrases), 100_000):
                        part = phrases.slice(i, 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), types[0]), pa.array([length] * len(part), types[1]), part, pa.array(n[i : i + 100_000], types[3])], names=names)
            ids.clear()
            texts.clear()

        for whole in batches:
            for b in slices(whole, "text"):
                for lang, text in zip(b.column("lang").to_pylist(), texts_of(b, "text")):
                    if lang not in ids:
                        ids[lang], texts[lang] = _Ids(), []
                    own = words_and_ends(text)
                    own.append(b".")
                    texts[lang].append(np.fromiter(map(ids[lang].__getitem__, own), np.int64, len(own)))
                    size += len(own)
                    if size >= FLUSH:
                        yield from flush()
                        size = 0
        yield from flush()

    made = docs.mapInArrow(run, "lang string, length int, phrase string, n bigint")
    return made.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))


def learn(known: Known, phrases: DataFrame, longest: int) -> Known | None:
    """known with the phrases (lang, length, phrase) that it lacks; None if it lacks none. What comes to the driver is at most
    one number for each 64 bits."""
    shared, bits = phrases.sparkSession.sparkContext.broadcast(known), known.bits

    def run(batches):
        for b in batches:
            by: dict[int, list[int]] = {}
            for lang, length, phrase in zip(*(b.column(c).to_pylist() for c in ("lang", "length", "phrase"))):
                own = _hash_words(phrase.encode("utf-8", "surrogatepass").split(b" "), _seed(lang))
                h = own[:1]
                for k in range(1, length):
                    h = _hash_longer(h, own[k : k + 1])
                by.setdefault(length, []).append(int(h[0]))
            for length, found in by.items():
                h = np.array(found, U)
                lacking = h[~shared.value.has(length, h)]
                if len(lacking):
                    at = shared.value.places(lacking).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([length] * len(at), pa.int32()), pa.array((at >> U(6)).astype(np.int64)), pa.array((at & U(63)).astype(np.int32))], names=["length", "slot", "bit"])

    made = phrases.where((F.col("length") > 0) & (F.col("length") < longest)).select("lang", "length", "phrase").mapInArrow(run, "length int, slot bigint, bit int")
    got = made.groupBy("length", "slot").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    if not got.num_rows:
        return None
    sets = {n: s.copy() for n, s in (known.sets or {}).items()}
    length, slot, word = (got.column(c).to_numpy() for c in ("length", "slot", "bits"))
    for n in np.unique(length).tolist():
        own = sets.setdefault(n, np.zeros(bits >> 6, U))
        own[slot[length == n]] |= word[length == n].astype(np.int64).view(U)
    return Known(bits, sets)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, int]:
    """All (lang, length, phrase, n) of docs (lang, text) with n >= least and 1 to longest words, and of length 0 a row for each lang with the number
    of its words; and the number of passes that took. A written table."""
    if filter_bits < 64 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits is a power of two, 64 or more")
    hashed = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("lang", "text", F.xxhash64("lang", "text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    drawn = hashed.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"]).select("lang", "text")
    every, old = Known(filter_bits, None), Known(filter_bits, {})
    proposed = counts(drawn, longest - 1, every, old, True).where(F.col("n") >= sample_least)
    new, parts = learn(old, proposed, longest) or old, []
    while True:
        # of a pass's rows only a small part is frequent, and only that part is written
        found = saved(counts(docs, longest, new, old, not parts).where((F.col("n") >= least) | (F.col("length") == 0)), "phrases")
        parts.append(found)
        more = learn(new, found, longest)
        if more is None:
            break
        new, old = more, new
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    whole = saved(out, "phrases")
    discard(*parts)
    return whole, len(parts)


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = COVERED, **options) -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score.

    A null language is `und`; null and empty texts have no words; repeated rows count as often as they come; other columns don't matter. Phrases of 2
    to `longest` words with a >= least occurrences are candidates. A cut into l and r occurrences of its two parts has the score
    floor(1000000 a a / (l r)), in decimals of 38 digits, exact for counts up to 10^15; the lowest counts, ties to the earliest cut. Candidates
    of which a longer candidate has `covered` percent of the occurrences or more are dropped. Order: score and a descending, phrase ascending by its bytes.
    An empty table has no rows.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found, _ = frequent_phrases(rows, least, longest, **options)
    known = found.where("length > 0").select("lang", "phrase", F.col("n").alias("c"))
    words = F.split("phrase", " ")
    candidates = found.where("length > 1").select("lang", "length", "phrase", F.col("n").alias("a"), words.alias("w"))
    # of longer candidates those with one word more suffice: they come as often at least as others that hold a phrase
    inner = F.explode(F.array(F.expr("array_join(slice(w, 1, length - 1), ' ')"), F.expr("array_join(slice(w, 2, length - 1), ' ')")))
    longer = candidates.where("length > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    cuts = left.select("lang", "phrase", "a", "w", "length", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, length - k), ' ')").alias("tail"))
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("c").alias(n))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    scored = scored.withColumns({"aa": whole("a") * whole("a"), "lr": whole("l") * whole("r")}).withColumn("score", F.expr("(aa * 1000000) div lr"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # first in parts, so that a language's last task has no more rows than PARTS times top
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = found.where("length = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM p),
one AS (SELECT lang, unnest(w) AS phrase FROM w),
g AS (SELECT lang, 1 AS k, phrase FROM one
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) >= 3),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM one GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
o AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
cut AS (SELECT c.*, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM c UNION ALL SELECT c.*, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT cut.lang, cut.phrase, cut.a, cut, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * cut.a * cut.a // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
  LEFT JOIN o ON o.lang = cut.lang AND o.phrase = cut.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * cut.a),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""
