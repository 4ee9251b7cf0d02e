"""Named queries over the test tables."""

from importlib import import_module

MODULES = ["evaluation", "learning", "parsing", "lexical", "facts", "feeds", "records", "dashboard", "contexts", "loops"]


def load_queries():
    """The registry with every plan module loaded."""
    for module in MODULES:
        import_module(f"tidemark.plans.{module}")
    from tidemark.plans.book import BOOK

    return BOOK
