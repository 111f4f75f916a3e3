"""Operators for training corpora: rules, deduplication, scans, packing, tokens, language models and extraction."""
