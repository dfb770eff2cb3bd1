"""Operators for preparing large text corpora: mixing, deduplication, filtering, tokenising."""
