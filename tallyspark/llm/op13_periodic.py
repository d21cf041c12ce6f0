"""Periodic runs of words: loops and stutters, as generated or badly scraped texts have them.

A suffix automaton reads a text's words. Its suffix links form a tree whose root path, from the state of the whole
text so far, holds all suffixes; a link-cut tree keeps that tree cut into paths of one colour, the place where a
path's words last ended. Each appended word accesses its root path and recolours it: a segment of that path of
colour e, with suffixes of up to m words, whose distance i - e is m at most, shows a square: two copies of i - e words
side by side that end here. Its root is primitive, or the last end would be nearer. Squares of one period that
end at successive words are one run. A text of n words takes O(n log n) recoloured segments.

Before that, words that no wanted run can hold are left out: in a run of at least EXPONENT periods all short phrases
come twice. What is left are stretches, and each is read by an automaton of its own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.common import slices, table, texts_of, without

EXPONENT, LEAST = 4, 6


class SquareFinder:
    """Suffix automaton whose link tree is kept as a link-cut tree. State 0 is none, 1 the empty text.

    Most states have one transition: it stands in two arrays, and only states with more have a dictionary."""

    def __init__(self) -> None:
        zeros = lambda: array("i", (0, 0))
        self.size, self.link, self.word, self.to = zeros(), zeros(), array("i", (-1, -1)), zeros()
        self.more: dict[int, dict[int, int]] = {}
        # of a path's splay tree, by depth: up also leads from its top to the path above; last holds at its top only
        self.up, self.left, self.right, self.last = zeros(), zeros(), zeros(), zeros()
        self.whole, self.n = 1, 0

    def _state(self, size: int) -> int:
        self.size.append(size)
        self.word.append(-1)
        for a in (self.link, self.to, self.up, self.left, self.right, self.last):
            a.append(0)
        return len(self.size) - 1

    def _next(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        many = self.more.get(state)
        return many.get(word, 0) if many else 0

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _splay(self, v: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = v
        while (u := up[top]) and (left[u] == top or right[u] == top):
            top = u
        self.last[v] = self.last[top]
        while (p := up[v]) and (left[p] == v or right[p] == v):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                turns = (p, v) if (left[g] == p) == (left[p] == v) else (v, v)
            else:
                turns = (v,)
            for x in turns:
                p = up[x]
                g = up[p]
                if left[p] == x:
                    c = left[p] = right[x]
                    right[x] = p
                else:
                    c = right[p] = left[x]
                    left[x] = p
                if c:
                    up[c] = p
                up[p], up[x] = x, g
                if g:
                    if left[g] == p:
                        left[g] = x
                    elif right[g] == p:
                        right[g] = x

    def append(self, word: int) -> list[int]:
        """Adds a word; the periods of the primitively rooted squares that end with it."""
        size, link, up = self.size, self.link, self.up
        i, p = self.n, self.whole
        self.n = i + 1
        cur = self._state(i + 1)
        while p and not (q := self._next(p, word)):
            self._lead(p, word, cur)
            p = link[p]
        if not p:
            link[cur] = 1
        elif size[p] + 1 == size[q]:
            link[cur] = q
        else:
            twin = self._state(size[p] + 1)
            self.word[twin], self.to[twin] = self.word[q], self.to[q]
            if q in self.more:
                self.more[twin] = dict(self.more[q])
            link[twin] = link[q]
            while p and self._next(p, word) == q:
                self._lead(p, word, twin)
                p = link[p]
            link[q] = link[cur] = twin
            # the twin stands right above q on q's path, and has ended where q has
            self._splay(q)
            above = self.left[q]
            self.left[twin], self.left[q], up[twin] = above, twin, q
            if above:
                up[above] = twin
        self.whole = cur
        up[cur] = link[cur]
        squares, below, v = [], cur, up[cur]
        while v:
            self._splay(v)
            ended = self.last[v]
            if 0 < i - ended <= size[v]:
                squares.append(i - ended)
            if self.right[v]:
                self.last[self.right[v]] = ended
            self.right[v] = below
            below, v = v, up[v]
        self.last[below] = i
        self._splay(cur)
        return squares


def stretch_runs(ids: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of at least two periods."""
    finder, open_, out = SquareFinder(), {}, []
    for i, word in enumerate(ids):
        for q in finder.append(word):
            seen = open_.get(q)
            if seen and seen[1] == i - 1:
                seen[1] = i
            else:
                if seen:
                    out.append((seen[0], seen[1] - seen[0] + 1, q))
                open_[q] = [i - 2 * q + 1, i]
    return out + [(a, b - a + 1, q) for q, (a, b) in open_.items()]


def phrase_length(exponent: int, least: int) -> int:
    """The longest k for which a run of max(least, exponent q) words holds each of its k-word phrases twice, for all q."""
    return min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2))


def stretches(ids: np.ndarray, k: int, rounds: int = 8) -> list[tuple[int, int]]:
    """(start, end) of the stretches of words that lie in k-word phrases which come twice in their stretch. Hashes that
    collide leave a stretch too long, never too short; so do fewer rounds."""
    n = len(ids)
    if n < k:
        return []
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - k + 1 + j].astype(np.uint64)
    start = np.arange(n - k + 1)  # of phrases that are left
    part = np.zeros(n - k + 1, np.uint64)
    for _ in range(rounds):
        key = (h[start] ^ (part * np.uint64(0xD1342543DE82EF95))) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(start), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        kept = start[twice]
        if not len(kept):
            return []
        # a run's phrases begin at every word, so a gap parts stretches
        new = np.concatenate([[True], np.diff(kept) > 1])
        part = np.cumsum(new).astype(np.uint64)
        if len(kept) == len(start):
            break
        start = kept
    first = np.flatnonzero(np.concatenate([[True], np.diff(start) > 1]))
    last = np.append(first[1:], len(start)) - 1
    return list(zip(start[first].tolist(), (start[last] + k).tolist()))


def runs_of(words: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs (start, length, smallest period) of at least `least` words and `exponent` periods, by start and period."""
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = []
    with np.errstate(over="ignore"):
        parts = stretches(ids, phrase_length(exponent, least))
    for a, b in parts:
        found += [(a + s, n, q) for s, n, q in stretch_runs(ids[a:b].tolist()) if n >= max(least, exponent * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words less those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def words_of(key: int | None, text: str) -> list[bytes]:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST, words: Callable[[int | None, str], list[bytes]] = words_of) -> DataFrame:
    """docs with n_words, runs (an array of start, length, period, by start and period) and collapsed_text, in which
    each run is cut to its first period and words are joined by one blank. Runs have at least two periods.

    A null text counts as an empty one; a text without words has no runs and an empty collapsed text. Rows are taken
    one by one: repeated rows and null keys change nothing. Columns of those three names are replaced, the others stay.
    words makes a text's words; it is given the key as well.
    """
    if exponent < 2 or least < 2:
        raise ValueError("a run has two periods at least")
    docs = without(docs, ["n_words", "runs", "collapsed_text"])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for b in slices(whole, text):
                n, runs, rest = [], [], []
                for k, t in zip(b.column(key).to_pylist(), texts_of(b, text)):
                    own = words(k, t)
                    found = runs_of(own, exponent, least)
                    n.append(len(own))
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                    rest.append(b" ".join(collapsed(own, found)))
                made = [pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(rest, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "n_words", "runs", "collapsed_text"])

    added = StructType.fromDDL("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def looped(key: int | None, text: str) -> list[bytes]:
    """The query's words: those of one document in ten, by the CRC-32 of its id, loop from a place on. A null id never does."""
    own = words_of(key, text)
    n, h = len(own), -1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return own
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return own[:a] + [own[a + (i - a) % p] for i in range(a, n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = periodic_runs(docs, words=looped)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("longest", longest)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
