"""Queries over the corpus operators; ``sql`` is the DuckDB text where there is one."""

from __future__ import annotations

from tidemark.plans.book import QueryBook

BOOK = QueryBook()
MODULES = ["queries", "repeats"]


def load():
    from importlib import import_module

    for module in MODULES:
        import_module(f"tidemark.llm.{module}")
    return BOOK
