"""Operators for preparing training corpora: deduplication, scoring, mixing and tokenizing."""
