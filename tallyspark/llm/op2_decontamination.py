"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some of a few consecutive word positions and ignores the others. Hashes of the kept
words are computed for every position of every benchmark item and of every text; equal hashes name
a text, an item and a diagonal. Along that diagonal the overlap around the hit is then compared
word by word, so that substituted words cost a little and don't hide a leak. The masks lose no
overlap: however the fifth of its words that may differ is placed, one mask falls on equal words.

The benchmark's hashes are joined as a sorted array, broadcast in blocks of at most BLOCK_CHARS
characters: texts are never shuffled, and a benchmark of any size takes one pass a block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, table, texts_of
from tallyspark.llm.words import U, hash_words, mix, seeds

#: Positions that count, of weight 6. Each placing of the substitutions that IDENTITY admits in 12 to 23 words
#: leaves one of them whole; a longer overlap has a part of 12 to 23 words that is as equal.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 4, 10, 11), (0, 1, 3, 7, 8, 9), (0, 1, 2, 5, 6, 10))
#: The same for items of fewer words, which must be there as a whole, by their number of words.
SHORT = {
    5: ((0, 1, 3, 4), (0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4)),
    6: ((0, 1, 3, 4), (0, 1, 2, 3)),
    7: ((0, 1, 3, 4),),
    8: ((0, 1, 3, 4, 5), (0, 1, 2, 6, 7)),
    9: ((0, 1, 3, 4, 5),),
    10: ((0, 1, 3, 4, 5), (0, 1, 2, 6, 7), (0, 1, 3, 6, 7)),
    11: ((0, 1, 3, 4, 5), (0, 1, 2, 6, 7)),
}
MIN_WORDS = 5
IDENTITY = 0.8
BLOCK_CHARS = 16_000_000
#: Pairs of equal hashes that are listed at a time.
MANY = 1_000_000
LEAK = "doc_id bigint, item_id bigint, doc_from int, doc_to int, matched int, overlap int, item_words int"


def needed(n: int) -> int:
    """Words of an n-word item that an overlap must hold: half of it, but no more than 25 and no
    fewer than 12; an item of fewer than 12 words must be there as a whole."""
    return min(n, max(12, min(math.ceil(n / 2), 25)))


def _masks(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks by which an n-word item is looked for."""
    return () if n < MIN_WORDS else SHORT.get(n, MASKS)


def _keyed(words: np.ndarray, kept: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(words) - kept[-1]
    if n <= 0:
        return np.zeros(0, U)
    h = np.full(n, U(salt + 1))
    for odd, o in zip(seeds(len(kept), salt) | U(1), kept):
        h = h + words[o : o + n] * odd
    return mix(h)


class Index:
    """Hashes of a block of items, sorted, with the item and the position of each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        hashes, offsets = hash_words([t or "" for _, t in items])
        self.words = [hashes[offsets[k] : offsets[k + 1]] for k in range(len(items))]
        self.masks = sorted({kept for w in self.words for kept in _masks(len(w))})
        keys, item, pos = [], [], []
        with np.errstate(over="ignore"):
            for m, kept in enumerate(self.masks):
                for k, w in enumerate(self.words):
                    if kept in _masks(len(w)):
                        h = _keyed(w, kept, m)
                        keys.append(h)
                        item.append(np.full(len(h), k))
                        pos.append(np.arange(len(h)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = np.concatenate(item)[order] if keys else np.zeros(0, np.int64)
        self.pos = np.concatenate(pos)[order] if keys else np.zeros(0, np.int64)
        self.bits = max(16, min(24, int(len(self.keys)).bit_length() + 5))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.keys >> U(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, item, diagonal) of the pairs of equal hashes, each once.

        Where words repeat, one hash may stand at many places of a text and of an item. Places of a text with equal
        words as far around as an item can reach give equal overlaps: of these, the first is taken. What is left is
        paired in parts of bounded size, each reduced to its different diagonals.
        """
        found = np.zeros(0, np.int64)
        reach = max(map(len, self.words), default=0)
        span = len(words) + reach + 1  # a triple as one number
        around = None
        for m, kept in enumerate(self.masks):
            with np.errstate(over="ignore"):
                h = _keyed(words, kept, m)
            at = np.flatnonzero(self.maybe[(h >> U(64 - self.bits)).astype(np.int64)])
            low, high = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            if n.sum() > MANY:
                around = _around(words, offsets, reach) if around is None else around
                with np.errstate(over="ignore"):
                    first = np.sort(np.unique(mix(around[at] + h[at]), return_index=True)[1])
                at, low, n = at[first], low[first], n[first]
            doc = np.searchsorted(offsets, at, "right") - 1
            cuts = np.searchsorted(np.cumsum(n), np.arange(MANY, n.sum() + MANY, MANY), "left") + 1
            begin = 0
            for end in np.unique(np.minimum(cuts, len(n))).tolist():
                x, y, c = slice(begin, end), low[begin:end], n[begin:end]
                begin = end
                if len(c):
                    k = np.repeat(y - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
                    new = (np.repeat(doc[x], c) * len(self.ids) + self.item[k]) * span + np.repeat(at[x] - offsets[doc[x]], c) - self.pos[k] + reach
                    found = np.unique(np.concatenate([found, new]))
        pair, diagonal = np.divmod(found, span)
        return np.stack([*np.divmod(pair, max(1, len(self.ids))), diagonal - reach], 1)

    def overlaps(self, text: np.ndarray, item: int, diagonals: np.ndarray):
        """For each diagonal the best-scoring stretch along it, +1 for an equal word and -2 for another, as
        (from, to, equal words) in the text, if it is long and equal enough."""
        w = self.words[item]
        m, need = len(w), needed(len(w))
        step = max(1, 1_000_000 // max(1, m))
        for k in range(0, len(diagonals), step):
            d = diagonals[k : k + step]
            low, high = np.maximum(0, -d), np.minimum(m, len(text) - d)
            place = d[:, None] + np.arange(m)
            live = (place >= 0) & (place < len(text))
            same = live & (text[np.clip(place, 0, len(text) - 1)] == w)
            zero = np.zeros((len(d), 1), np.int64)
            score = np.concatenate([zero, np.cumsum(np.where(same, 1, np.where(live, -2, 0)), 1)], 1)
            equal = np.concatenate([zero, np.cumsum(same, 1)], 1)
            lowest = np.minimum.accumulate(score, 1)
            rows = np.arange(len(d))
            end = np.argmax(score - lowest, 1)
            begin = np.maximum(low, np.argmax(score == lowest[rows, end][:, None], 1))
            matched = equal[rows, end] - equal[rows, begin]
            # a substitution every third word scores nothing above; take the whole overlap then
            weak = (end - begin < need) | (matched < IDENTITY * (end - begin))
            begin, end = np.where(weak, low, begin), np.where(weak, high, end)
            matched = np.where(weak, equal[:, -1], matched)
            good = (high - low >= need) & (matched >= IDENTITY * (end - begin))
            yield from zip((d + begin)[good].tolist(), (d + end)[good].tolist(), matched[good].tolist())

    def overlap(self, text: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """overlaps of one diagonal, or None."""
        return next(self.overlaps(text, item, np.array([diagonal])), None) if len(text) else None

    def leaks(self, texts: list[str]) -> dict[int, list[tuple]]:
        """Of each text that holds some: (item id, from word, to word, equal words, length, item's words), the best for each item."""
        words, offsets = hash_words(texts)
        found: dict[int, list[tuple]] = {}
        pairs = self.hits(words, offsets)
        starts = np.flatnonzero(np.any(np.diff(pairs[:, :2], axis=0, prepend=-1), 1)).tolist()
        for a, b in zip(starts, starts[1:] + [len(pairs)]):
            doc, item = pairs[a, :2].tolist()
            best = max(((m, -x, y - x) for x, y, m in self.overlaps(words[offsets[doc] : offsets[doc + 1]], item, pairs[a:b, 2])), default=None)
            if best:
                found.setdefault(doc, []).append((self.ids[item], -best[1], -best[1] + best[2], best[0], best[2], len(self.words[item])))
        return found


def _around(words: np.ndarray, offsets: np.ndarray, reach: int) -> np.ndarray:
    """For each word a hash of its text's number, of the words up to `reach` before and 2 * reach after it, and of how near the text's ends are."""
    n = len(words)
    odd = int(seeds(1, 5)[0]) | 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n + 1, U(odd)))
        back = np.cumprod(np.full(n + 1, U(pow(odd, -1, 1 << 64))))
        total = np.concatenate(([U(0)], np.cumsum(words * power[:n])))
        doc = np.searchsorted(offsets, np.arange(n), "right") - 1
        low, high = np.maximum(offsets[doc], np.arange(n) - reach), np.minimum(offsets[doc + 1], np.arange(n) + 2 * reach)
        ends = (np.arange(n) - low).astype(U) * U(0x9E3779B97F4A7C15) + (high - np.arange(n)).astype(U)
        return mix((total[high] - total[low]) * back[low] + mix(ends) + mix(doc.astype(U) + U(1)))


def indexes(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """A broadcast index for each block of the benchmark; the number of blocks follows its size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).dropDuplicates().collect()
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in rows]))


_built: dict[str, Index] = {}


def _index(shared) -> Index:
    """One index a worker process and block."""
    key, items = shared.value
    if key not in _built:
        _built.clear()
        _built[key] = Index(items)
    return _built[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each text and each benchmark item that it holds: the words it spans in the text
    (from, to), equal words, overlap and the item's words.

    Null and empty texts hold nothing; items of fewer than MIN_WORDS words aren't looked for.
    Repeated rows of docs give repeated rows, repeated items one. Other columns don't matter.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((n, pa.int32()) for n in ("doc_from", "doc_to", "matched", "overlap", "item_words"))])

    def looked(shared):
        def run(batches):
            index = _index(shared)
            for whole in batches:
                for batch in slices(whole, "text"):
                    ids = batch.column("doc_id").to_pylist()
                    rows = [(ids[d], *x) for d, xs in index.leaks(texts_of(batch, "text")).items() for x in xs]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        return run

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [read.mapInArrow(looked(x), LEAK) for x in indexes(benchmark, block_chars)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, unchanged and with all their columns, whose text holds no benchmark item."""

    def cleaned(shared):
        def run(batches):
            index = _index(shared)
            for whole in batches:
                for batch in slices(whole, text):
                    leaked = index.leaks(texts_of(batch, text))
                    yield batch.filter(pa.array([i not in leaked for i in range(batch.num_rows)])) if leaked else batch

        return run

    for shared in indexes(benchmark, block_chars):
        docs = docs.mapInArrow(cleaned(shared), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
