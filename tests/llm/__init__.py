"""Tests of the corpus operators: brute force, edge cases, held-out accuracy."""
