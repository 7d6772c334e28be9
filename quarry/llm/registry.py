"""The queries of this package by name, and the SQL of those that SQL can express."""

from . import bpe, gif, hard_negatives, html_text, language, minhash, mixing, quality, token_files, toxicity, url_filter, vector_codes, warc

MODULES = [bpe, gif, hard_negatives, html_text, language, minhash, mixing, quality, token_files, toxicity, url_filter, vector_codes, warc]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
