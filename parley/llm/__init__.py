"""Training-data operators: dedup, decontamination, PII, quality, toxicity, mixing, chat formatting.

Nothing outside this subpackage imports it; ``queries.py`` registers the queries.
"""
