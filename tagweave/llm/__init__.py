"""Operators of a training-data pipeline; nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

#: One module for each operator, in the order of their numbers.
MODULES = ("quality", "bpe", "chat", "minhash", "mixing", "passages", "sharding", "audio", "licenses", "toxicity", "importance", "divergence", "pii")


def _modules():
    return [importlib.import_module(f"{__name__}.{name}") for name in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
