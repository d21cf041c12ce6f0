"""Matroska files in columns: packet tables, and a writer that stores bytes losslessly.

The reader walks variable-length EBML elements: segment, info, tracks, cues, and clusters with
simple blocks and block groups, with no, Xiph, EBML or fixed-size lacing. Each frame becomes a row
with its track, timestamp and byte range. Work is a file at a time inside a task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import slices, table, texts_of

# EBML and Matroska element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_IDLEN, EBML_SIZELEN, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION = 0x2AD7B1, 0x4489
ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION, LANGUAGE = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383, 0x22B59C
TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

HERTZ, FRAME, CLUSTER_FRAMES = 8000, 4096, 16
PACKETS = "file_id bigint, packet int, track int, timestamp_ns bigint, keyframe boolean, lacing string, cluster int, byte_from bigint, byte_to bigint, cued boolean"


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return _id(kind) + _size(len(data)) + data


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(track: int, offset_ms: int, frames: list[bytes]) -> bytes:
    """A key-frame block; several frames are laced, with fixed sizes where they are equal, else EBML."""
    head = _size(track) + offset_ms.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    if len({len(f) for f in frames}) == 1:
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    sizes = _size(len(frames[0]))
    for a, b in zip(frames, frames[1:-1]):
        d = len(b) - len(a)
        width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
        sizes += _size(d + (1 << 7 * width - 1) - 1, width)
    return head + b"\x86" + bytes([len(frames) - 1]) + sizes + b"".join(frames)


def store(payload: bytes) -> bytes:
    """A file with one track of 8-bit mono samples, 8 kHz, whose samples are the payload's bytes."""
    head = _element(EBML, _number(EBML_VERSION, 1), _number(EBML_READ, 1), _number(EBML_IDLEN, 4), _number(EBML_SIZELEN, 8), _element(DOCTYPE, b"matroska"), _number(DOCTYPE_VERSION, 4), _number(DOCTYPE_READ, 2))
    info = _element(INFO, _number(SCALE, 1_000_000))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", HERTZ)), _number(CHANNELS, 1), _number(DEPTH, 8))
    tracks = _element(TRACKS, _element(ENTRY, _number(NUMBER, 1), _number(UID, 1), _number(KIND, 2), _element(CODEC, b"A_PCM/INT/LIT"), _number(DEFAULT_DURATION, FRAME * 10**9 // HERTZ), audio))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // HERTZ
    clusters, at, where = [], len(info) + len(tracks), []
    for c in range(0, len(frames), CLUSTER_FRAMES):
        blocks, mine = [], frames[c : c + CLUSTER_FRAMES]
        for k in range(0, len(mine), 4):
            blocks.append(_element(SIMPLE, _block(1, k * ms, mine[k : k + 4])))
        cluster = _element(CLUSTER, _number(TIMESTAMP, c * ms), *blocks)
        where.append((c * ms, at))
        at += len(cluster)
        clusters.append(cluster)
    cues = _element(CUES, *[_element(CUE_POINT, _number(CUE_TIME, t), _element(CUE_POSITIONS, _number(CUE_TRACK, 1), _number(CUE_CLUSTER, p))) for t, p in where])
    return head + _element(SEGMENT, info, tracks, *clusters, cues)


def _vint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(value without its length marker, next position); -1 for an unknown size."""
    if at >= end or not data[at]:
        raise ValueError("no variable-length number here")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError("a number is cut off")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def _elements(data: bytes, at: int, end: int, parent: int = 0):
    """(id, start, body's start, body's end) of the elements in a range. One of unknown size ends at
    the next element that can't be inside it, or with its parent; the last one may be cut off."""
    while at < end:
        start = at
        if not data[at]:
            raise ValueError("no element id here")
        width = 9 - data[at].bit_length()
        kind = int.from_bytes(data[at : at + width], "big")
        size, body = _vint(data, at + width, end)
        if size < 0:
            stop = end
            if kind == CLUSTER:
                for k, s, _, e in _elements(data, body, end, CLUSTER):
                    if k in TOP_LEVEL:
                        stop = s
                        break
        else:
            stop = min(end, body + size)
        yield kind, start, body, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """(track, timestamp offset, flags, lacing, byte ranges of the frames) of a block."""
    track, at = _vint(data, at, end)
    offset, flags, at = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    lacing = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    if lacing == "none":
        return track, offset, flags, lacing, [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == "xiph":
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == "ebml":
        for k in range(n - 1):
            first = at
            value, at = _vint(data, at, end)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - first) - 1) - 1))
    else:
        sizes = [(end - at) // n] * (n - 1)
    ranges = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("a laced frame leaves its block")
        ranges.append((at, at + size))
        at += size
    return track, offset, flags, lacing, [*ranges, (at, end)]


def packets(data: bytes) -> list[tuple]:
    """(packet, track, timestamp ns, key frame, lacing, cluster, from, to, cued) of each frame in file
    order. Laced frames follow one another at their track's default duration. A file that isn't
    Matroska has none; one that breaks off has those up to there."""
    out: list[tuple] = []
    scale, durations, cued, begins = 1_000_000, {}, set(), []
    try:
        for kind, _, a, b in _elements(data, 0, len(data)):
            if kind != SEGMENT:
                continue
            base, cluster = a, -1
            for kind, start, a, b in _elements(data, a, b, SEGMENT):
                if kind == INFO:
                    scale = next((_uint(data, x, y) for k, _, x, y in _elements(data, a, b) if k == SCALE), scale)
                elif kind == TRACKS:
                    for k, _, x, y in _elements(data, a, b):
                        if k == ENTRY:
                            own = {k: _uint(data, x, y) for k, _, x, y in _elements(data, x, y) if k in (NUMBER, DEFAULT_DURATION)}
                            durations[own.get(NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
                elif kind == CUES:
                    for k, _, x, y in _elements(data, a, b):
                        for k, _, x, y in _elements(data, x, y) if k == CUE_POINT else ():
                            for k, _, x, y in _elements(data, x, y) if k == CUE_POSITIONS else ():
                                if k == CUE_CLUSTER:
                                    cued.add(base + _uint(data, x, y))
                elif kind == CLUSTER:
                    cluster, time = cluster + 1, 0
                    begins.append(start)
                    for k, _, x, y in _elements(data, a, b, CLUSTER):
                        if k == TIMESTAMP:
                            time = _uint(data, x, y)
                        for z, key, p, q in [(k, None, x, y)] if k == SIMPLE else [(k2, REFERENCE not in {e[0] for e in _elements(data, x, y)}, p, q) for k2, _, p, q in _elements(data, x, y) if k2 == BLOCK] if k == GROUP else []:
                            track, offset, flags, lacing, ranges = _frames(data, p, q)
                            for i, (f, t) in enumerate(ranges):
                                out.append((len(out), track, (time + offset) * scale + i * durations.get(track, 0), bool(flags & 0x80) if key is None else key, lacing, cluster, f, t))
    except (ValueError, IndexError):
        pass
    return [(*r, begins[r[5]] in cued) for r in out]


def packet_table(files: DataFrame, id_column: str = "file_id", content: str = "content") -> DataFrame:
    """A row for each packet of each file of a binary column.

    A null, empty or foreign file has no packets; a file that is cut off has those before the cut.
    Repeated rows give repeated packets; other columns don't matter.
    """
    schema = pa.schema([("file_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("cluster", pa.int32()), ("byte_from", pa.int64()), ("byte_to", pa.int64()), ("cued", pa.bool_())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "content"):
                rows = [(i, *p) for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if c for p in packets(c)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select(F.col(id_column).cast("bigint").alias("file_id"), F.col(content).alias("content")).mapInArrow(run, PACKETS)


def padded(text: str) -> tuple[int, bytes]:
    """(length in UTF-8, the bytes with zeros up to a positive multiple of 64)."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def digest(text: str) -> tuple:
    """Stores a text, reads it back through its packet table and computes the query's columns."""
    n, payload = padded(text)
    media = store(payload)
    rows = packets(media)
    back = b"".join(media[r[6] : r[7]] for r in rows)
    lacing = Counter(r[4] for r in rows)
    feature = f"packets={len(rows)};clusters={rows[-1][5] + 1 if rows else 0};cued={sum(r[8] for r in rows)};end_ns={rows[-1][2] if rows else 0};" + ";".join(f"{k}={lacing[k]}" for k in sorted(lacing))
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text stored as a Matroska file, and what the file's packets hold. Null texts
    count as empty ones, which are stored as 64 zeros; repeated rows give repeated rows."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [(i, *digest(t)) for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
