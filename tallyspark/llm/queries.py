"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyspark.llm import op1_mixing, op2_decontamination, op3_pii, op4_matroska, op5_urls, op6_chat, op7_quality, op8_html, op9_neardup, op10_warc, op11_phrases, op12_lines, op13_periodic


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing.query,
    "op2_decontamination": op2_decontamination.query,
    "op3_pii": op3_pii.query,
    "op4_matroska": op4_matroska.query,
    "op5_urls": op5_urls.query,
    "op6_chat": op6_chat.query,
    "op7_quality": op7_quality.query,
    "op8_html": op8_html.query,
    "op9_neardup": op9_neardup.query,
    "op10_warc": op10_warc.query,
    "op11_phrases": op11_phrases.query,
    "op12_lines": op12_lines.query,
    "op13_periodic": op13_periodic.query,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_mixing": op1_mixing.SQL,
    "op5_urls": op5_urls.SQL,
    "op6_chat": op6_chat.SQL,
    "op10_warc": op10_warc.SQL,
    "op11_phrases": op11_phrases.SQL,
    "op12_lines": op12_lines.SQL,
}
