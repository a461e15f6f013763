"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

from quarrylight.llm.common import bounded
from quarrylight.session import shipped

_MODULES = ("topk", "packing", "chat", "langid", "decontaminate", "simhash", "suffixes", "quality", "sharding", "urls")


def _prepared(query):
    return shipped(lambda spark, *args: query(bounded(spark), *args))


def queries() -> dict:
    return {k: _prepared(f) for m in _MODULES for k, f in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in importlib.import_module(f"{__name__}.{m}").ORACLE_SQL.items()}
