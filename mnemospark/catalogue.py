"""All registered queries of the engine, and the SQL that says the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemospark.plans.registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_retrieval"
for _area in ("history", "models", "state", "content", "ranking", "context", "forest", "memory", "evaluation", "policies", "files", "logs", "neighbours", "paging", "payloads", "replay", "semantic", "snapshots", "spans", "supersession", "summaries", "whole"):
    importlib.import_module(f"mnemospark.plans.{_area}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
