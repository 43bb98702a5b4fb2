"""Operators for preparing language-model training data (tokens, dedup, PII, quality, archives, shards)."""
