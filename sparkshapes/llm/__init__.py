"""Operators for preparing training text; nothing else in the library imports this package."""

from __future__ import annotations

import sys
from importlib import import_module

from pyspark import cloudpickle

# Workers get this package's functions with the tasks, so they need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MODULES = ("toxicity", "near_dedup", "sentencepiece_codec", "chat_format", "token_counts", "exact_dedup", "fingerprints", "suffix_dedup", "language_id", "mixing")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
