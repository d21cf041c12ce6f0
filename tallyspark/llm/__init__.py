"""Training-data operators: mixing, decontamination, PII surrogates, media packets, URL rules,
chat formatting, quality scoring, main-text extraction, near-duplicates and WARC archives.

Nothing outside this subpackage imports it.
"""
