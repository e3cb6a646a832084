"""Operators for preparing large text corpora: deduplication, scans, classification, tokenization and search."""
