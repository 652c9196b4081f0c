"""The queries of this package by name, and the SQL of those that SQL can express."""

from lodestone.llm import bpe, lm_scoring, media, mixing, near_dedup, quality_ranking, quality_rules, token_files, toxicity, warc

_MODULES = (bpe, lm_scoring, media, mixing, near_dedup, quality_ranking, quality_rules, token_files, toxicity, warc)


def queries():
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles():
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
