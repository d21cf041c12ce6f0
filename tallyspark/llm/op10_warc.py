"""Web archives with a shared Zstandard dictionary.

Each archive starts with a skippable frame that holds the dictionary (compressed when that is
shorter), followed by one frame a record, each compressed on its own with the dictionary, so that a
reader can start at any record. Of records with equal payloads one is a response and the others
revisit it. Archives are written as rows of bytes into the folder that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import saved, slices, table, texts_of

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: The dictionary is built from at most so many records of at most so many characters.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 800, 50_000, 65_536
ARCHIVE_BYTES, LEVEL = 8_000_000, 6
#: Repeated rows of one id, url and payload that a part of a task makes anew.
TIES = 10_000
#: Bytes of an archive that are handed to the reader at a time.
FEED = 16_384


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, none (empty)."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record_bytes(url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record whose header holds the digest and length of the full payload; a revisit has no payload.
    Line breaks can't occur in header values: a url is percent-encoded where it holds control characters."""
    safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{safe}')}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {safe}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def opening(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    frame = min(packed, dictionary, key=len)
    return struct.pack("<II", DICTIONARY_FRAME, len(frame)) + frame


def read_archive(data: bytes):
    """(headers, payload) of each record, in order: reads the dictionary first, then frame by frame."""
    at, known = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        frame, at = data[8 : 8 + size], 8 + size
        if frame[:4] == b"\x28\xb5\x2f\xfd":
            frame = zstandard.ZstdDecompressor().decompress(frame)
        known = zstandard.ZstdCompressionDict(frame)
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        # fed in parts: what is left of one is copied, not the rest of the archive
        one, parts = reader.decompressobj(), []
        while not one.eof and at < len(data):
            parts.append(one.decompress(view[at : at + FEED]))
            at = min(len(data), at + FEED) - len(one.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(headers["Content-Length"])
        if len(rest) != n + 4:
            raise ValueError("a record is cut off")
        yield headers, rest[:n]


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with record_type and refers_to. Of equal payloads of min_bytes or
    more, the smallest page_id is the response; of repeated rows with that id one is. Null ids come last.

    Payloads are compared by digest. Digests with copies are found from partial counts by id, without
    payloads; these are then shuffled once, and a digest with many copies is a skewed join that Spark
    splits. Repeated rows of a smallest id are counted by url and made anew from their counts, TIES to a task's part, so
    that no task holds them all: one of the first url (a null one before others) is the response.
    """
    rows = pages.withColumn("__sha", F.sha1("payload"))
    each = rows.where(F.octet_length("payload") >= min_bytes).groupBy("__sha", "page_id").agg(F.count("*").alias("c"))
    first = each.groupBy(F.col("__sha").alias("s")).agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "c")).alias("f"), F.sum("c").alias("n"))
    copies = saved(first.where("n > 1").select("s", F.col("f.page_id").alias("first"), F.col("f.c").alias("ties")), "copies")
    joined = rows.join(copies, F.col("__sha") == F.col("s"), "left")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    made = lambda df, response: df.select("page_id", "url", "payload", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first")).alias("refers_to"))
    out = made(joined.where(F.col("s").isNull() | (F.col("ties") == 1) | ~same), F.col("s").isNull() | same)
    many = copies.where("ties > 1")
    if many.isEmpty():
        return out
    tied = rows.join(many, F.col("__sha") == F.col("s")).where(same)
    urls = tied.groupBy("__sha", "page_id", "first", "url").agg(F.count("*").alias("c"), F.first("payload").alias("payload"))
    lead = urls.groupBy("__sha").agg(F.min(F.struct(F.col("url").isNotNull(), "url"))["url"].alias("lead"))
    parts = urls.join(lead, "__sha").withColumn("part", F.explode(F.expr(f"sequence(0, (c - 1) div {TIES})"))).repartition("__sha", "url", "part")
    again = parts.withColumn("turn", F.explode(F.expr(f"sequence(part * {TIES} + 1, least(c, (part + 1) * {TIES}))")))
    return out.unionByName(made(again, (F.col("turn") == 1) & F.col("url").eqNullSafe(F.col("lead"))))


def write_archives(records: DataFrame, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (name, n_records, content) of about archive_bytes each, written to the shared folder.
    A record is never split; one that is longer than an archive has one of its own."""
    shared = records.sparkSession.sparkContext.broadcast(dictionary)
    types = [pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True) if known else zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        lead = opening(shared.value)
        parts, size, n = [lead], len(lead), 0

        def archive():
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((hashlib.sha1(data).hexdigest()[:16] + ".warc.zst", n, data), types)], names=["name", "n_records", "content"])

        for whole in batches:
            for b in slices(whole, "payload"):
                for page, url, text, kind, to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "record_type", "refers_to"))):
                    payload = text.encode("utf-8", "surrogatepass")
                    frame = writer.compress(record_bytes(url or "", page, payload, payload_digest(payload), to, kind == "revisit"))
                    if n and size + len(frame) > archive_bytes:
                        yield archive()
                        parts, size, n = [lead], len(lead), 0
                    parts.append(frame)
                    size, n = size + len(frame), n + 1
        if n:
            yield archive()

    return saved(records.mapInArrow(run, "name string, n_records bigint, content binary"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of each archive. A response's digest and length are those of the payload
    read; one that differs from its header is an error. A revisit has those that its header names."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    number = lambda x: int(x) if x else None

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = []
                for h, payload in read_archive(data):
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (n, digest) != (len(payload), payload_digest(payload)):
                        raise ValueError("a payload differs from its digest")
                    rows.append((number(h["X-Page-Id"]), n, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id")), h["WARC-Target-URI"]))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("content").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the archives.

    A null html counts as empty, a null url as an empty one. An empty table gives no archives.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    # the payloads first by hash: their hashes are found without payloads, and of copies one is drawn
    some = rows.where(F.length("payload").between(1, SAMPLE_CHARS)).withColumn("h", F.xxhash64("payload"))
    last = some.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    drawn = some.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min_by(F.struct("page_id", "url", "payload"), F.struct("page_id", "url")).alias("r")).select("h", "r.*").orderBy("h")
    samples = [record_bytes(r.url or "", r.page_id, p := r.payload.encode("utf-8", "surrogatepass"), payload_digest(p), None, False) for r in drawn.collect()]  # SAMPLE rows
    return write_archives(deduplicated(rows, min_bytes), build_dictionary(samples))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive_pages(table(spark, sf_dir, "pages"))).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
ranked AS (SELECT page_id, html, sha1(html) AS digest, row_number() OVER (PARTITION BY html ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1), '' ORDER BY i)
        FROM (SELECT g.i AS i, CAST(substr(bits, 5 * g.i + 1, 5)::BIT::INT AS INT) AS v FROM range(32) g(i))) AS payload_digest,
       CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN first END AS refers_to
FROM (SELECT *, unhex(digest)::BIT::VARCHAR AS bits FROM ranked)
"""
