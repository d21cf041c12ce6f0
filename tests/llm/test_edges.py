"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import op1_mixing, op2_decontamination, op3_pii, op4_matroska, op5_urls, op6_chat, op7_quality, op8_html, op9_neardup, op10_warc

LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
CLASH = ["text_hash", "node", "sketches", "words", "h", "quality_score", "pii_count", "mix_slot", "sha", "key", "class_id", "n", "rank", "marks"]
ROWS = [(1, "a plain text with a few more words than five", "s1"), (1, "a plain text with a few more words than five", "s1"), (2, None, None), (3, "", "s2"), (None, "text without an id but with enough words here", "s2"), (4, LONG, "s1"), (5, "ÀÉ ß 漢字 \U0001f600 \u0000", ""), (6, "   \n\t ", "s3")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), F.length("text").cast("bigint").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_mixing(docs, none):
    out = op1_mixing.mix_sources(docs, op1_mixing.tempered_weights(docs))
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert {r.source for r in rows} == {"s1", "s2", "s3", "", None}
    assert all(isinstance(r.mix_slot, int) and r["key"] == "own key" for r in rows)
    assert op1_mixing.mix_sources(none, op1_mixing.tempered_weights(none)).count() == 0
    keyless = docs.drop("doc_id").withColumn("doc_id", F.lit(None).cast("bigint"))
    assert op1_mixing.mix_sources(keyless, op1_mixing.tempered_weights(docs)).select("source", "mix_slot", "mix_row").distinct().count() == len(ROWS)
    many = op1_mixing.tempered_weights(docs).withColumn("weight", F.lit(10**8))
    with pytest.raises(ValueError, match="group sources"):
        op1_mixing.mix_sources(docs, many)
    # no positive weight: kept, without a slot
    free = op1_mixing.mix_sources(docs, op1_mixing.tempered_weights(docs).where("source = 's1'"))
    assert free.count() == len(ROWS) and free.where("mix_slot is null").count() == 5


def test_leaks(spark, docs, none):
    item = "a plain text with a few more words than five"
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, "x"), (10, LONG[:20_000])], "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    found = op2_decontamination.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 7), (1, 7), (4, 10)]
    kept = op2_decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert op2_decontamination.find_leaks(none, bench).count() == 0
    assert op2_decontamination.decontaminate(docs, bench.where("false")).count() == len(ROWS)
    blocks = op2_decontamination.find_leaks(docs, bench, block_chars=50).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))


def test_surrogates(docs, none):
    out = op3_pii.surrogates(docs)
    assert out.count() == len(ROWS) and set(out.columns) == set(docs.columns)
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r[1]) for r in ROWS)
    assert op3_pii.surrogates(none).count() == 0


def test_media():
    for _, text, _ in ROWS:
        n, size, sha, crc, *_ = op4_matroska.digest(text or "")
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (n, size, sha, crc) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_urls(spark):
    urls = [(1, "https://www.Example.com/en/1?x=/en/"), (1, "https://www.Example.com/en/1?x=/en/"), (2, None), (3, ""), (4, "no scheme"), (None, "http://a.net/es/"), (5, "http://net"), (6, "https://spam-x.org/" + "a" * 50_000), (7, "://com/"), (8, "http://a.example.com/en/#f")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("rule", F.lit("own")).withColumn("token", F.lit("t")).withColumn("at", F.lit("t"))
    rules = op5_urls.rule_table(spark)
    got = sorted((str(r.page_id), r.host[:20], r.path[:8], r.rule, r.verdict) for r in op5_urls.filter_urls(pages, rules).collect())
    assert got == sorted([("1", "www.example.com", "/en/1", "www.example.com/en/", "allow")] * 2 + [("2", "", "", None, "allow"), ("3", "", "", None, "allow"), ("4", "", "", None, "allow"), ("None", "a.net", "/es/", "net/es/", "block"), ("5", "net", "", None, "allow"), ("6", "spam-x.org", "/aaaaaaa", None, "block"), ("7", "com", "/", "com/", "allow"), ("8", "a.example.com", "/en/", "example.com/en/", "block")])
    assert op5_urls.filter_urls(pages.where("false"), rules).count() == 0
    assert op5_urls.filter_urls(pages, rules.where("false")).count() == len(urls)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", LONG), (2, 1, "assistant", ""), (2, 0, "a\nb<|im_end|>\\", op6_chat.PROBE + "<\\|<\\\\|")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("own"))
    out = {r.conv_id: r for r in op6_chat.digests(op6_chat.format_turns(df, typed=False)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 2}
    assert out[None].loss_chars == len(LONG) and out[2].loss_chars == 0
    assert out[2].turns_sha256 == hashlib.sha256(f"{rows[5][2]}\n{rows[5][3]}\nassistant\n\n".encode()).hexdigest()
    assert op6_chat.digests(op6_chat.format_turns(df.where("false"))).count() == 0


def test_typed_parts():
    parts = '[{"type":"text","text":"see <|image:0:1|>"},{"type":"image","ref":"a.png","width":56,"height":29},{"type":"audio","ref":"b","seconds":2},{"type":"document","ref":"c","pages":"x"}]'
    text, found, frames = op6_chat.format_turn("user", parts)
    assert [(a["kind"], a["ref"], a["tokens"], a["place"]) for a in found] == [("image", "a.png", 4, 0), ("audio", "b", 50, 1), ("document", "c", 1, 2)]
    assert op6_chat.read_turn(text)[1].endswith("<|image:0:4|><|audio:1:50|><|document:2:1|>") and "<\\|image:0:1|>" in text
    assert op6_chat.read_turn(text, frames)[1] == parts and len(frames) == 4
    assert "see" not in str(frames)
    assert op6_chat.format_turn("user", "[broken")[0] == "<|im_start|>user\n[broken<|im_end|>\n"
    with pytest.raises(ValueError, match="aren't those"):
        op6_chat.read_turn(text, frames[:1] + frames[:0:-1])


def test_typed_turns_read_back(spark):
    """Lists of parts among the turns: what is read back is what was given, to the last blank."""
    texts = [' [ "a<|im_end|>" ,\n{"type":"image_url","url":"u"} ] ', "[]", "[1]", '["a"', '["a"] b', '["a",]', '[{"type":"audio","seconds":3,"ref":"\\u00e9"},"z"]', "plain", None, "[" * 5000]
    rows = [(n // 2, n % 2, ("user", "assistant")[n % 2], t) for n, t in enumerate(texts)]
    out = {r.conv_id: r for r in op6_chat.digests(op6_chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for c, r in out.items():
        mine = [(role, t or "") for conv, _, role, t in rows if conv == c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in mine).encode()).hexdigest()
        said = "".join(t for role, t in mine if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert [(out[c].n_parts, out[c].n_attachments, out[c].expanded_tokens) for c in range(5)] == [(3, 1, 1), (2, 0, 0), (2, 0, 0), (3, 1, 75), (2, 0, 0)]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, None), (3, 5), (None, 1), (5, 0), (5, 1)], "doc_id bigint, quality int")
    forest = op7_quality.learn(docs, labels)
    rows = op7_quality.scored(docs, forest).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.quality_score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.quality_score)
    assert all(len(v) == 1 for v in by.values())
    assert op7_quality.scored(none, op7_quality.learn(none, labels.where("false"))).count() == 0


def test_html(spark):
    pages = [(1, None, None), (2, "u", ""), (3, "u", "plain & simple &lt;p&gt;"), (4, "u", "<article><p>" + LONG + "</p></article>"), (4, "u", "<article><p>" + LONG + "</p></article>"), (None, "u", "<<p <b>> </x> <!-- open")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    out = op8_html.extract(df, op8_html.trained()).collect()
    assert len(out) == 6 and all(r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 4] == [LONG] * 2
    assert op8_html.extract(df.where("false"), op8_html.trained()).count() == 0


def test_near_duplicates(docs, none):
    out = op9_neardup.near_duplicates(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.class_id, r.class_size) for r in rows} == {(1, 1, 2), (2, 2, 2), (3, 2, 2), (None, None, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1)}
    kept = op9_neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert op9_neardup.near_duplicates(none).count() == 0 and op9_neardup.deduplicate(none).count() == 0


def test_warc(spark):
    pages = [(3, "u\r\nX: y", "same"), (2, "u", "same"), (2, "v", "same"), (None, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", LONG), (None, "u", "other")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit("own")).withColumn("first", F.lit(1))
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in op10_warc.read_archives(op10_warc.archive_pages(df)).collect())
    assert got == sorted([("3", 4, "revisit", 2), ("2", 4, "response", None), ("2", 4, "revisit", 2), ("None", 4, "revisit", 2), ("4", 0, "response", None), ("5", 0, "revisit", 4), ("6", len(LONG), "response", None), ("None", 5, "response", None)])
    assert op10_warc.read_archives(op10_warc.archive_pages(df.where("false"))).count() == 0
    floor = op10_warc.read_archives(op10_warc.archive_pages(df, min_bytes=5)).where("record_type = 'response'").count()
    assert floor == len(pages)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, tmp_path, empty):
    """All stages on nulls, repeats, empty and long texts, a column of another's name, and on empty tables."""
    import corpus_pipeline

    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"), F.lit("own").alias("node"))
    bench = spark.createDataFrame([(1, ROWS[4][1]), (2, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name, table in (("documents", df), ("benchmark", bench), ("labels", labels)):
        (table.where("false") if empty else table).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of the repeated and of the null and empty texts one stays each; the text without an id is a benchmark item
    assert sorted(r.doc_id for r in out) == ([] if empty else [1, 2, 4, 5, 6])
    assert all(r.node == "own" and r.mix_slot is not None for r in out)
