"""Queries on whole tables against plain recounts, and on tables that are empty, repeated or have columns of their names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def held(text, item):
    """The best overlap of an item's words with a text's, over all diagonals: (equal words, from, to), or None."""
    n, found = len(item), []
    need = min(n, max(12, min(math.ceil(n / 2), 25)))
    places = defaultdict(list)
    for p, w in enumerate(item):
        places[w].append(p)
    equal = Counter(i - p for i, w in enumerate(text) for p in places.get(w, ()))
    for d, count in equal.items():
        low, high = max(0, -d), min(n, len(text) - d)
        if count < 0.8 * need or high - low < need:
            continue
        same = [text[d + p] == item[p] for p in range(low, high)]
        score = lowest = gain = at = begin = end = 0
        for k, s in enumerate(same, 1):
            score += 1 if s else -2
            if score < lowest:
                lowest, at = score, k
            if score - lowest > gain:
                gain, begin, end = score - lowest, at, k
        if end - begin < need or sum(same[begin:end]) < 0.8 * (end - begin):
            begin, end = 0, len(same)
        if (m := sum(same[begin:end])) >= 0.8 * (end - begin):
            found.append((m, -(d + low + begin), end - begin))
    if not found:
        return None
    m, start, length = max(found)
    return m, -start, -start + length


def test_leaks_of_the_table_on_both_sides(spark):
    """No leak is missed and none is too many: every text against every item, whose words are compared one by one."""
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    docs = {r.doc_id: split(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = {r.item_id: split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for d, text in docs.items():
        known = set(text)
        for i, item in bench.items():
            n = len(item)
            if n >= 5 and sum(w in known for w in item) >= 0.8 * min(n, max(12, min(math.ceil(n / 2), 25))) and (x := held(text, item)):
                want[d, i] = x
    got = {(r.doc_id, r.item_id): (r.matched, r.doc_from, r.doc_to) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    assert want and got == want


def test_media_query_on_odd_tables(spark, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (None, "x"), (3, "é" * 200_000), (4, "a" * 64), (5, "a" * 65)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("payload_bytes", F.lit("own")).withColumn("__text", F.lit(1)).withColumn("feature", F.lit(None).cast("string"))
    df.write.parquet(f"{tmp_path}/some/documents.parquet")
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    got = QUERIES["op4_matroska"](spark, f"{tmp_path}/some").collect()
    want = []
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1
    none = QUERIES["op4_matroska"](spark, f"{tmp_path}/none")
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_records_of_repeated_rows(spark, monkeypatch):
    """Many rows of one id and payload, in parts of any size: each row has a record, and one of the first url is the response."""
    from tallyspark.llm import op10_warc

    rows = [(7, u, "same") for u in ["b"] * 11 + ["a"] * 4 + ["c"]] + [(8, u, "other") for u in [None] * 5 + ["a"] * 2] + [(None, "z", "third")] * 6 + [(9, "b", "same"), (9, "b", "same"), (10, "x", "alone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    first = {"same": (7, "a"), "other": (8, ""), "third": (None, "z"), "alone": (10, "x")}
    want, said = [], set()
    for i, url, text in rows:
        response = (i, url or "") == first[text] and text not in said
        said |= {text} if response else set()
        want.append((str(i), url or "", len(text), "response" if response else "revisit", str(None if response else first[text][0])))
    for ties in (1, 3, 4, 10_000):
        monkeypatch.setattr(op10_warc, "TIES", ties)
        got = op10_warc.read_archives(op10_warc.archive_pages(df)).collect()
        assert sorted((str(r.page_id), r.url, r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
