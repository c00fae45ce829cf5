"""Queries of the corpus operators with their SQL oracles.

Every query reads the given tables; its rows grow with them. Arrays are returned as text. Long tables
(word pairs, matrix cells) are returned summed up per word or row.
"""

from __future__ import annotations

from . import queries_align, queries_files, queries_phrases, queries_prep, queries_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (queries_prep, queries_align, queries_phrases, queries_tables, queries_files):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES


def flagship(spark, sf_dir):
    """The phrase table of the extracted pairs."""
    return QUERIES["tab1_phrase_table"](spark, sf_dir)
