"""Operators for building training corpora: filters, near duplicates, scoring, search and mixing."""
