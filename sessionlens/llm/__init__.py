"""Training-data operators over a table of documents, one module each, with their registered queries."""

from importlib import import_module

MODULES = ["sharding", "exact_dedup", "bpe_codec", "token_counts", "packing", "line_dedup", "language_id", "quality_rules", "ngram_join", "secret_scan",
           "alignment", "lexical_search", "suffix_dedup"]


def load():
    """Import all operators and return the catalog of their queries."""
    for module in MODULES:
        import_module(f"sessionlens.llm.{module}")
    return import_module("sessionlens.llm.catalog")
