"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are counts over the whole text, computed for many texts at once in numpy. Trees are
fitted to binned statistics of a bounded sample of labelled documents, then flattened into arrays
of features, thresholds and children, along which all rows of a batch descend together.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tallyspark.llm.common import slices, table, texts_of, without
from tallyspark.llm.words import hash_words

#: Labelled documents to learn from, at most: those first by a hash of their id.
SAMPLE = 20_000
#: Longest text to learn from, in characters; all texts are scored whole.
SAMPLE_CHARS = 200_000
THRESHOLD = 0.3
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 48, 60, 4, 0.2, 5, 1.0
_SYMBOLS = "|!?#$%&*@<>{}[]()\"'=+/\\_~^.,;:-"
NAMES = ["log_chars", "log_words", "word_mean", "word_sd", "long_words", "short_words", "upper", "digit", "space", "other", "non_ascii", "log_lines", "line_mean", "empty_lines", "unique_words", "unique_lines", "repeats", "char_entropy", "upper_words", "ended", *[f"sym {c}" for c in _SYMBOLS]]


def _classes() -> np.ndarray:
    """A class for each of the first 128 characters: symbols by place, then upper, lower, digit, line, blank, rest."""
    kinds = np.full(129, len(_SYMBOLS) + 5, np.int64)
    for i, c in enumerate(_SYMBOLS):
        kinds[ord(c)] = i
    for a, b, k in ((65, 91, 0), (97, 123, 1), (48, 58, 2)):
        kinds[a:b] = len(_SYMBOLS) + k
    kinds[10], kinds[[9, 13, 32]] = len(_SYMBOLS) + 3, len(_SYMBOLS) + 4
    kinds[128] = len(_SYMBOLS) + 6
    return kinds


_KINDS = _classes()


def statistics(texts: list[str]) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros throughout."""
    n, s = len(texts), len(_SYMBOLS)
    out = np.zeros((n, len(NAMES)), np.float64)
    if not n:
        return out
    # the one letter whose lower-casing lengthens a text, so that the places of words are those of their letters
    texts = [t.replace("\u0130", "I") for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, n)
    doc = np.repeat(np.arange(n), sizes)
    kind = _KINDS[np.minimum(codes, 128)]
    counts = np.bincount(doc * (s + 7) + kind, minlength=n * (s + 7)).reshape(n, s + 7).astype(float)
    chars = np.maximum(sizes, 1).astype(float)
    words, offsets, begin, end = hash_words(texts, spans=True)
    n_words = np.diff(offsets)
    many = np.maximum(n_words, 1)
    of = np.repeat(np.arange(n), n_words)
    length = (end - begin).astype(float)
    total = lambda x: np.bincount(of, x, n)
    mean = total(length) / many
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(sizes), np.log1p(n_words), mean
    out[:, 3] = np.sqrt(np.maximum(total(length**2) / many - mean**2, 0))
    out[:, 4], out[:, 5] = total(length >= 12) / many, total(length <= 3) / many
    out[:, 6], out[:, 7], out[:, 8], out[:, 9] = counts[:, s] / chars, counts[:, s + 2] / chars, counts[:, s + 4] / chars, counts[:, s + 5] / chars
    out[:, 10], out[:, 11] = counts[:, s + 6] / chars, np.log1p(counts[:, s + 3])
    out[:, 12] = chars / (1 + counts[:, s + 3])
    share = counts / chars[:, None]
    out[:, 17] = -(share * np.log(np.where(share > 0, share, 1))).sum(1)
    base = np.concatenate(([0], np.cumsum(sizes)))
    upper = np.concatenate(([0], np.cumsum(kind == s)))
    at = np.repeat(base[:-1], n_words)
    out[:, 18] = total(((upper[at + end] - upper[at + begin]) == length) & (length > 1)) / many
    for i, t in enumerate(texts):
        w = words[offsets[i] : offsets[i + 1]]
        if len(w):
            values, times = np.unique(w, return_counts=True)
            out[i, 14], out[i, 16] = len(values) / len(w), times.max() / len(w)
        if lines := t.split("\n"):
            full = [x for x in lines if x.strip()]
            out[i, 13] = 1 - len(full) / len(lines)
            out[i, 15] = len(set(full)) / max(1, len(full))
            out[i, 19] = sum(x.rstrip()[-1] in ".!?…:;\"”»" for x in full) / max(1, len(full))
    out[:, 20:] = counts[:, :s] / np.maximum(n_words, 1)[:, None]
    out[sizes == 0] = 0
    return out


@dataclass
class Forest:
    """Trees as arrays: node k asks whether statistic feature[k] is at most threshold[k]; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        at = np.repeat(self.roots[None], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Logistic loss, gradients and curvatures summed in histograms of each statistic, level by level.
    Without examples, or with those of one label only, the forest is a constant."""
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    f, t, l, r, v, roots = [], [], [], [], [], []

    def leaf(value: float) -> int:
        f.append(0), t.append(np.inf), l.append(len(v)), r.append(len(v)), v.append(value)
        return len(v) - 1

    if not len(y) or y.min() == y.max():
        roots.append(leaf(0.0))
        return Forest(base, *map(np.array, (roots, f, t, l, r, v)), 0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], 1)  # bin <= k: at most cuts[k]
    margin = np.full(len(y), base)
    n_features = x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        grow = [(leaf(0.0), np.arange(len(y)))]
        roots.append(grow[0][0])
        for level in range(depth + 1):
            below = []
            for node, rows in grow:
                gs, hs = g[rows].sum(), h[rows].sum()
                v[node] = float(-RATE * gs / (hs + RIDGE))
                margin[rows] += v[node] if level == depth or len(rows) < 2 * LEAST else 0
                if level == depth or len(rows) < 2 * LEAST:
                    continue
                flat = (bins[rows] + np.arange(n_features) * BINS).ravel()
                spread = lambda z: np.bincount(flat, np.repeat(z[rows], n_features), n_features * BINS).reshape(n_features, BINS).cumsum(1)  # noqa: B023, E731
                gl, hl = spread(g), spread(h)
                nl = np.bincount(flat, minlength=n_features * BINS).reshape(n_features, BINS).cumsum(1)
                gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                best = int(np.argmax(gain))
                j, k = divmod(best, BINS)
                if gain[j, k] <= 1e-9 or k >= len(cuts[j]):
                    margin[rows] += v[node]
                    continue
                go = bins[rows, j] <= k
                f[node], t[node] = j, float(cuts[j][k])
                a, b = leaf(0.0), leaf(0.0)
                l[node], r[node] = a, b
                below += [(a, rows[go]), (b, rows[~go])]
            grow = below
    return Forest(base, *map(np.array, (roots, f, t, l, r, v)), depth)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from learning; a null id is."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Learns from labelled documents that aren't held out: the `sample` ids first by hash, so that
    the driver gets at most `sample` rows of statistics. Null and contradicting labels are left out, and texts of more
    than SAMPLE_CHARS characters. Of rows that share an id, the one of the smallest statistics counts."""
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most `sample` short rows
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(chosen, "doc_id")

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(statistics(texts_of(b, "text")).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "y", "text").mapInArrow(run, "doc_id bigint, y int, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()
    got = got.sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(got.column("y").to_pylist(), float))


def scored(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """docs with quality_score, 0 to 1. Null and empty texts get the score of an empty text. Equal texts,
    equal scores. A column quality_score of docs is replaced; the others, whatever their names, stay."""
    docs = without(docs, ["quality_score"])
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand numbers

    def run(batches):
        for whole in batches:
            for b in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(statistics(texts_of(b, text))), pa.float64())], names=[*b.schema.names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("quality_score", DoubleType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    forest = learn(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, forest)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
