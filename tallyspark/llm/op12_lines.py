"""Line deduplication against levelled sorted runs of line hashes.

A run is a table of keys, digests of lines, with the number of documents that hold them, bucketed and sorted by key in the
shared folder. A batch of documents shuffles its own keys once, to the buckets of the runs; merge anti-joins with
the runs take off the keys that are settled, that is, found in enough documents already, and the rest is written as a run of its
own. Two runs of one level are merged into one of the next, so that there are few runs and each key is rewritten
a logarithmic number of times. Runs are never shuffled. Once all batches are in, lines with settled keys go.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.llm.common import discard, new_folder, saved, slices, table, texts_of, without

LEAST_DOCS, LEAST_CHARS, BATCHES = 10, 1, 4


def keyed(text: str, least_chars: int = LEAST_CHARS) -> list[tuple[bytes, bytes | None]]:
    """The lines of a text, in UTF-8, each with the digest of its key: the line without blanks, tabs, line and form feeds, vertical
    tabs and carriage returns at its ends, with A-Z in lower case. A key under least_chars code points is none."""
    out = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(b" \t\n\v\f\r").lower()  # lowers A-Z only
        long = key and (least_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= least_chars)
        out.append((line, hashlib.md5(key).digest() if long else None))
    return out


def line_keys(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(node, key, copies): the different keys of each different text, and its number of rows. node is the text's digest."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                nodes, keys = [], []
                for node, t in zip(b.column("node").to_pylist(), texts_of(b, "text")):
                    own = {k for _, k in keyed(t, least_chars) if k}
                    nodes += [node] * len(own)
                    keys += own
                for i in range(0, len(keys), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 50_000], pa.binary()), pa.array(keys[i : i + 50_000], pa.binary())], names=["node", "key"])

    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    made = docs.select(F.unhex(F.md5(whole)).alias("node"), whole.alias("text")).mapInArrow(run, "node binary, key binary")
    return made.groupBy("node", "key").agg(F.count("*").alias("copies"))


class LineRuns:
    """Runs (key, docs) by level. A key is settled in a run that counts it in least_docs documents."""

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, buckets: int | None = None) -> None:
        self.spark, self.least_docs = spark, least_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame | None] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        at = new_folder(self.spark, "line-run")
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", at).option("compression", "zstd").saveAsTable(name)
        run = self.spark.table(name)
        run.saved_at, run.name = at, name
        return run

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE {run.name}")
        discard(run)

    @staticmethod
    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs' rows, merged bucket by bucket: each task has one bucket's rows, in order."""
        rows = a.withColumnRenamed("docs", "before").join(b, "key", "full")
        return rows.select("key", (F.coalesce("before", F.lit(0)) + F.coalesce("docs", F.lit(0))).alias("docs"))

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        merged = self._write(self.both(a, b))
        self._drop(a)
        self._drop(b)
        return merged

    def settled(self) -> Iterable[DataFrame]:
        return [run.where(F.col("docs") >= self.least_docs).select("key") for run in self.levels if run]

    def add(self, lines: DataFrame) -> None:
        """Adds a batch's lines (key, copies), those of settled keys aside."""
        own = lines.groupBy("key").agg(F.sum("copies").alias("docs"))
        for keys in self.settled():
            own = own.join(keys, "key", "left_anti")
        run, level = self._write(own.repartition(self.buckets, "key")), 0
        while level < len(self.levels) and (other := self.levels[level]):
            run, self.levels[level], level = self._merge(other, run), None, level + 1
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = run

    def close(self) -> DataFrame:
        """Merges all runs; the settled keys of the whole."""
        runs = [run for run in self.levels if run]
        self.levels = []
        while len(runs) > 1:
            runs = [self._merge(*runs[:2]), *runs[2:]]
        if not runs:
            return self.spark.createDataFrame([], "key binary")
        keys = saved(runs[0].where(F.col("docs") >= self.least_docs).select("key"), "settled")
        self._drop(runs[0])
        return keys


def drop_lines(docs: DataFrame, lines: DataFrame, settled: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, without the lines of settled keys. lines are line_keys of docs."""
    docs = without(docs, ["n_lines", "n_dropped", "kept_text"])
    gone = lines.join(settled, "key", "left_semi").groupBy(F.col("node").alias("__node")).agg(F.collect_list("key").alias("__gone"))
    gone = saved(gone, "gone")  # a join right after the aggregate would keep its partitions, and with them all copies of a text in one task
    own = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    joined = docs.withColumn("__own", own).join(gone, F.col("__own") == F.col("__node"), "left").drop("__own", "__node")

    def run(batches):
        for whole in batches:
            for b in slices(whole, text):
                n, dropped, kept = [], [], []
                for t, gone in zip(texts_of(b, text), b.column("__gone").to_pylist()):
                    if gone:
                        gone = set(gone)
                        all_ = keyed(t, least_chars)
                        rest = [line for line, key in all_ if key not in gone]
                        n.append(len(all_))
                        dropped.append(len(all_) - len(rest))
                        kept.append(b"\n".join(rest))
                    else:
                        n.append(t.count("\n") + 1)
                        dropped.append(0)
                        kept.append(t.encode("utf-8", "surrogatepass"))
                columns = [c for name, c in zip(b.schema.names, b.columns) if name != "__gone"]
                names = [name for name in b.schema.names if name != "__gone"]
                made = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, "n_lines", "n_dropped", "kept_text"])

    added = StructType.fromDDL("n_lines bigint, n_dropped bigint, kept_text string")
    return joined.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def dedup_lines(docs: DataFrame, text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines whose key at least least_docs documents hold are dropped from all.

    A document is a row, so repeated rows count as often as they come; a line that a document repeats counts once, and all its
    lines go. A null or empty text is one empty line, which has no key and stays. Lines of blanks only have none either.
    Columns of the three names are replaced, the others stay. The rows come in `batches` parts, by a hash of their text;
    the number of parts doesn't change the result.
    """
    lines = saved(line_keys(docs, text, least_chars), "lines")
    runs = LineRuns(docs.sparkSession, least_docs)
    for i in range(batches):
        runs.add(lines.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == i))
    return drop_lines(docs, lines, runs.close(), text, least_chars)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id
"""
