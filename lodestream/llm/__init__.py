"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; `queries()` and `oracle_sql()` gather
the registered queries of its modules. Modules are imported on demand, so a
Python worker loads only what its task uses.
"""

from importlib import import_module

_MODULES = (
    "lm_score", "toxicity", "mixing", "line_dedup", "decontaminate",
    "licences", "simhash", "topk", "token_files", "secrets",
    "vector_codes", "token_alignment", "superminhash",
)


def _modules():
    return [import_module(f"{__name__}.{m}") for m in _MODULES]


def queries():
    """Name to callable (spark, sf_dir) of every operator query here."""
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql():
    """Name to DuckDB SQL, for the queries that SQL can express."""
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}
