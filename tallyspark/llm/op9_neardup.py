"""Near-duplicates by order MinHash, verified by banded alignment.

Texts are runs of five words, each labelled with its occurrence number. A sketch draws the L runs of
smallest hash and keeps them in text order, so equal sketches mean shared runs in a shared order;
SKETCHES of them are drawn. Texts that share a sketch are aligned: with M runs aligned in order, of
n and m, their similarity is M / (n + m - M), and 0.8 or more links them. Classes are the connected
components of the links.

Equal texts are one node from the start. Within a sketch's bucket no pairs are listed up front: members
are aligned with a leader, that which shares most buckets (in large buckets with their part's, and those with one). Only texts of buckets that this
leaves in several classes go on: of them, pairs of different classes are aligned if they share one
of their rarest runs, as two similar texts must. So no link between texts that met is lost, and texts
of one class don't meet again.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, saved, slices, table, texts_of
from tallyspark.llm.words import U, hash_words, mix, seeds, shingles

K, SKETCHES, L = 5, 16, 3
#: Members of a bucket that one leader takes; larger buckets have several, which their first leads.
LED = 64
#: A written table of pairs or classes with this many rows at most (some 10 MB) is broadcast; a larger one is shuffled.
FEW = 100_000
#: A written table of short rows has a file for so many of them, an alignment a task for so many pairs, and as many as there are cores at least.
FILE_ROWS, TASK_PAIRS = 50_000, 1_000
#: Similarity as a fraction, so that ties at 0.8 are exact.
SIMILAR = (4, 5)


def labelled(runs: np.ndarray) -> np.ndarray:
    """Each run's hash with the number of times that it has occurred before."""
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    times = np.empty(n, U)
    times[order] = (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))).astype(U)
    with np.errstate(over="ignore"):
        return mix(runs + times * U(0x9FB21C651E98DF25))


def sketch(runs: np.ndarray, n_sketches: int = SKETCHES, keep: int = L) -> np.ndarray:
    """n_sketches hashes of a text's runs; none for a text without words."""
    n = len(runs)
    if not n:
        return np.zeros(0, np.int64)
    marked = labelled(runs)
    with np.errstate(over="ignore"):
        keep = min(keep, n)
        out = np.empty(n_sketches, U)
        step = max(1, 1_000_000 // n)
        salts = seeds(n_sketches, 77)
        for a in range(0, n_sketches, step):
            s = salts[a : a + step, None]
            values = (marked[None] ^ s) * (s | U(1))
            values ^= values >> U(32)
            values *= U(0xD6E8FEB86659FD93)
            least = np.sort(np.argpartition(values, keep - 1, axis=1)[:, :keep], axis=1)
            h = s[:, 0].copy()
            for j in range(keep):
                h = mix(h * U(0xC2B2AE3D27D4EB4F) + marked[least[:, j]])
            out[a : a + step] = h
    return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, at_least: tuple[int, int] = SIMILAR) -> bool:
    """Whether runs a and b align well enough: M / (n + m - M) >= p / q.

    Equal ends are taken off. Only matches within the band that the needed M allows count. Where matches
    are few, their longest increasing chain is M; else a banded dynamic programme, a row at a time.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    p, q = at_least
    need = -(-p * (n + m) // (p + q))
    if need > min(n, m):
        return False
    short = min(n, m)
    other = a[:short] != b[:short]
    head = int(other.argmax()) if other.any() else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    other = a[::-1][:short] != b[::-1][:short]
    tail = int(other.argmax()) if short and other.any() else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if need <= 0:
        return True
    if need > min(len(a), len(b)):
        return False
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    low, high = np.searchsorted(ranked, a, "left"), np.searchsorted(ranked, a, "right")
    if int((high > low).sum()) < need:
        return False
    matches = int((high - low).sum())
    band = len(a) + len(b) - 2 * need
    if matches <= 8 * (len(a) + len(b)) + 1000:
        ends: list[int] = []
        for i in np.flatnonzero(high > low).tolist():
            for j in order[low[i] : high[i]][::-1].tolist():  # larger first: one match a row
                if abs(i - j) <= band:
                    k = bisect_left(ends, j)
                    if k == len(ends):
                        ends.append(j)
                    else:
                        ends[k] = j
        return len(ends) >= need
    width = 2 * band + 1
    row = np.zeros(width + 1, np.int64)  # row[k]: best for b up to i + k - band
    padded = np.concatenate([np.zeros(band + 1, U), b, np.zeros(band + len(a) + 1, U)])
    real = np.concatenate([np.zeros(band + 1, bool), np.ones(len(b), bool), np.zeros(band + len(a) + 1, bool)])
    for i in range(len(a)):
        window = slice(i + 1, i + 1 + width)
        gain = row[:width] + ((padded[window] == a[i]) & real[window])
        row[:width] = np.maximum.accumulate(np.maximum(gain, row[1:]))
        row[width] = row[width - 1]
    return int(row.max()) >= need


def nodes(docs: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """A row for each different text (columns of docs: text): node, its digest; words, hashed; n, its
    number of runs; sketches. Copies are folded before and after the shuffle."""
    types = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64())]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                words, offsets = hash_words(texts_of(b, "text"))
                short = words.astype(np.uint32)
                cut = [short[offsets[i] : offsets[i + 1]] for i in range(b.num_rows)]
                runs = [shingles(w, K) for w in cut]
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.array([w.tobytes() for w in cut], types[1]), pa.array(map(len, runs), types[2]), pa.array([sketch(r, sketches) for r in runs], types[3])],
                    names=["node", "words", "n", "sketches"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    made = read.mapInArrow(run, "node binary, words binary, n int, sketches array<bigint>")
    return made.groupBy("node").agg(F.first("words").alias("words"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))


def few(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows, marked for broadcast where the written table `of`, which has at least as many, has FEW rows at most."""
    return F.broadcast(rows) if of.count() <= FEW else rows


def fitted(df: DataFrame, most: int, each: int = FILE_ROWS) -> DataFrame:
    """df, of `most` rows at most, in a partition for `each` of them instead of one for each of the shuffle's: a small table written
    in many files costs more than what is in it. No fewer than there are cores, so that none is left without work."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // each)))


def verified(pairs: DataFrame, of: DataFrame, known: DataFrame, at_least: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align, written; of: a written table that holds the pairs, or more."""
    types = [pa.binary(), pa.binary()]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "wb"):
                keep, last, runs = [], None, None
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "wa", "wb"))):
                    if a != last:
                        last, runs = a, shingles(np.frombuffer(x, np.uint32), K)
                    if similar(runs, shingles(np.frombuffer(y, np.uint32), K), at_least):
                        keep.append((a, b))
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keep), types)], names=["a", "b"])

    left = known.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = known.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    texts = few(pairs.select("a", "b"), of).join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return saved(fitted(texts, of.count(), TASK_PAIRS).mapInArrow(run, "a binary, b binary"), "links")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, class) of the nodes of edges (a, b), `most` of them or a written table; class: the smallest node that can be reached.

    Each round gives a node the smallest class among its own and its neighbours', then that class's own
    class; rounds end when a digest of the table stays the same. Each is written to the shared folder.
    """
    ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
    both = saved(fitted(ends.select("e.a", "e.b").distinct(), 4 * (edges.count() if most is None else most)), "edges")
    most = both.count()
    now, digest, last = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("class")), None, None
    while True:
        now = saved(fitted(now, most), "classes")
        before, digest = digest, now.agg(F.sum(F.xxhash64("node", "class").cast("decimal(38,0)"))).first()[0]
        if last is not None:
            discard(last)
        if digest == before:
            discard(both)
            return now
        last = now
        near = both.join(few(now.select(F.col("node").alias("b"), F.col("class").alias("c")), now), "b").groupBy("a").agg(F.min("c").alias("c"))
        up = few(now.select(F.col("node").alias("c"), F.col("class").alias("top")), now)
        now = near.join(up, "c", "left").select(F.col("a").alias("node"), F.least("c", F.coalesce("top", "c")).alias("class"))


def rarest_runs(some: DataFrame, classes: DataFrame, known: DataFrame, at_least: tuple[int, int] = SIMILAR) -> DataFrame:
    """(node, n, run, pos, class), written: of each of some nodes the rarest of its n runs, counted among these nodes,
    as many as it may lack of a similar text's, and one more, with its class. Of two similar texts' rarest runs, one is shared."""
    types = [pa.binary(), pa.int64()]
    p, q = at_least

    def run(batches):
        for whole in batches:
            for b in slices(whole, "words", 1_000_000):
                parts = [labelled(shingles(np.frombuffer(w, np.uint32), K)) for w in b.column("words").to_pylist()]
                owners = [n for n, r in zip(b.column("node").to_pylist(), parts) for _ in range(len(r))]
                yield pa.RecordBatch.from_arrays([pa.array(owners, types[0]), pa.array(np.concatenate(parts).view(np.int64), types[1])], names=["node", "run"])

    runs = saved(known.join(some, "node", "left_semi").select("node", "words").mapInArrow(run, "node binary, run bigint"), "runs")
    # counted from partial counts and joined, so that a run that many texts hold is no single task's work
    times = runs.groupBy("run").agg(F.count("*").alias("times"))
    own = Window.partitionBy("node")  # a text's own runs
    placed = runs.join(times, "run").select("node", "run", F.row_number().over(own.orderBy("times", "run")).alias("pos"), F.count("*").over(own).cast("int").alias("n"), "times")
    placed = placed.where(f"times > 1 and pos <= n - (n * {p} + {q - 1}) div {q} + 1").drop("times")
    placed = placed.join(few(classes, classes), "node", "left").withColumn("class", F.coalesce("class", "node"))
    return saved(fitted(placed, runs.count()), "rarest")


def remaining_pairs(placed: DataFrame, at_least: tuple[int, int] = SIMILAR) -> DataFrame:
    """Of rarest runs with their nodes' classes, pairs (a, b) of nodes of different classes that may be similar, with the number of runs by which they met: they share one of as many rarest
    runs as each may lack of the other, and enough runs are left from there on. Of the nodes at a run, those of its largest
    class don't meet each other."""
    p, q = at_least
    large = placed.groupBy("run", "class").agg(F.count("*").alias("c")).groupBy("run").agg(F.max_by("class", F.struct("c", "class")).alias("large"), F.count("*").alias("several")).where("several > 1")
    placed = placed.join(large.select("run", "large"), "run")
    x, y = placed.where("class <> large").alias("x"), placed.alias("y")
    need = f"((x.n + y.n) * {p} + {p + q - 1}) div {p + q}"
    meet = x.join(y, F.expr(f"x.run = y.run and x.class <> y.class and x.pos <= x.n - {need} + 1 and y.pos <= y.n - {need} + 1 and least(x.n - x.pos, y.n - y.pos) + least(x.pos, y.pos) >= {need}"))
    return meet.groupBy(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).agg(F.count("*").alias("shared"))


def merged(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes (node, class) after links (a, b) between nodes; a node without a class is its own. Only classes are searched."""
    own = lambda side: few(classes.select(F.col("node").alias(side), F.col("class").alias(f"c{side}")), classes)
    between = found.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    tops = components(between, found.count()).select(F.col("node").alias("class"), F.col("class").alias("top"))
    fresh = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti").withColumn("class", F.col("node"))
    joined = classes.unionByName(fresh).join(few(tops, tops), "class", "left").select("node", F.coalesce("top", "class").alias("class"))
    return saved(fitted(joined, classes.count() + 2 * found.count()), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", sketches: int = SKETCHES, at_least: tuple[int, int] = SIMILAR) -> DataFrame:
    """A row for each row of docs: key, node (digest of its text), class_id, the smallest key of its
    class, class_size, in rows, and links, the number of alignments found between its text and others.

    A null text counts as an empty one; texts without words are alike only if they are equal. Texts
    of fewer than five words are one run. Case and punctuation don't count. Rows with equal texts are
    of one class whatever their keys; class_id is null where all keys of the class are. Other columns
    don't matter.
    """
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    known = saved(nodes(docs, sketches), "nodes")
    buckets = known.select("node", F.explode("sketches").alias("h"))
    shared = buckets.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    # a text's weight: the members of all its buckets; a family's common form has most, and leads
    weight = F.sum("size").over(Window.partitionBy("node"))  # a text's own sketches
    # a large bucket is cut by a hash of its nodes into parts of about LED, each with a leader, and those have one leader
    parts = F.greatest(F.ceil(F.col("size") / LED), F.lit(1)).cast("bigint")
    members = buckets.join(shared, "h").withColumn("weight", weight).withColumn("part", F.pmod(F.xxhash64("node"), parts))
    n_nodes = known.count()
    members = saved(fitted(members, sketches * n_nodes), "buckets")
    n_members = members.count()
    known = saved(known.join(members, "node", "left_semi").select("node", "words"), "candidates")
    lead = F.min(F.struct(-F.col("weight"), "node")).over(Window.partitionBy("h", "part"))  # about LED rows
    led = saved(fitted(members.select("h", "node", "size", lead.alias("lead")), n_members), "leaders")
    leaders = led.where((F.col("node") == F.col("lead.node")) & (F.col("size") > LED))
    top = leaders.groupBy("h").agg(F.min("lead").alias("top"))
    below = led.select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
    above = leaders.join(top, "h").select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    pairs = below.unionByName(above).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = saved(fitted(pairs, 2 * n_members), "pairs")
    discard(led)
    edges = verified(pairs, pairs, known, at_least)
    classes = components(edges)
    split = members.join(few(classes, classes), "node", "left").withColumn("class", F.coalesce("class", "node"))
    split = split.groupBy("h").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.count("*").alias("size")).where("c0 <> c1 and size > 2")
    # a row for each part of a bucket, so that a large one is not met in one task
    split = split.select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    some = members.join(split, ["h", "part"], "left_semi").select("node").distinct()
    rest = remaining_pairs(rarest_runs(some, classes, known, at_least), at_least)
    rest = saved(rest.join(few(pairs, pairs), ["a", "b"], "left_anti"), "pairs")
    # each node's most promising pair first: its links settle most of the others
    of_a = rest.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("p")).select("a", "p.b")
    of_b = rest.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("p")).select("p.a", "b")
    best = of_a.unionByName(of_b).distinct()
    found = verified(best, rest, known, at_least)
    classes, edges = merged(classes, found), edges.unionByName(found)
    now = few(classes.select(F.col("node").alias("a"), F.col("class").alias("ca")), classes), few(classes.select(F.col("node").alias("b"), F.col("class").alias("cb")), classes)
    left = rest.join(now[0], "a", "left").join(now[1], "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    found = verified(left, rest, known, at_least)
    classes, edges = merged(classes, found), edges.unionByName(found)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    rows = docs.select("key", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("node"))
    texts = rows.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    texts = texts.join(few(classes, classes), "node", "left").join(degree, "node", "left").withColumn("class", F.coalesce("class", "node"))
    texts = saved(fitted(texts, n_nodes), "texts")
    # written first: a join right after the aggregate would keep its partitions, with a large class whole in one task, while
    # one of two tables is broadcast or split by AQE
    sizes = saved(fitted(texts.groupBy("class").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size")), n_nodes), "sizes")
    facts = texts.join(sizes, "class").select("node", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    return rows.join(facts, "node").select(F.col("key").alias(key), "node", "class_id", "class_size", "links")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class, all its columns unchanged: the one with the smallest key; of
    rows that share it and the text, the first by their other columns. A class whose keys are all null keeps one row as well."""
    found = near_duplicates(docs, key, text, **options)
    # one text a class: that of its smallest key, the smaller digest where two texts share it
    winners = found.groupBy(F.coalesce(F.col("class_id").cast("string"), F.hex("node")).alias("c")).agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("node").alias("d"))).alias("w"))
    winners = winners.select(F.col("w.k").alias("__dup_key"), F.col("w.d").alias("__dup_node"))
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    kept = docs.withColumn("__dup_own", digest).join(winners, (F.col("__dup_own") == F.col("__dup_node")) & F.col(f"`{key}`").eqNullSafe(F.col("__dup_key")), "left_semi")
    # rows that share key and text: the first by their other columns, as JSON
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]), {"ignoreNullFields": "false"})
    one = kept.groupBy("__dup_own").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), rest).alias("__dup_row"))
    return one.select(*[F.col("__dup_row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
