"""Training-data operators: building blocks for preparing large text corpora on Spark.

Each module holds one operator with a general DataFrame interface, the thin
``opN_*`` query that applies it to its whole table, and (where SQL can express
it) the DuckDB statement for the same rows. ``QUERIES`` and ``ORACLE_SQL`` collect them.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = ["bpe", "embedding_dedup", "quality", "toxicity", "token_file", "url_filter", "substring_dedup", "packing", "simhash", "line_dedup", "mixing", "periodic", "conversations"]


def queries() -> dict:
    found = {}
    for name in _MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        found |= import_module(f"{__name__}.{name}").ORACLE_SQL
    return found
