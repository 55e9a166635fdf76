"""Every query of the library outside the llm folder, with its SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.registry import QUERIES, SQL

#: Modules that register queries.
MODULES = (
    "operators.profile", "operators.projections", "operators.quality", "operators.joins", "operators.aggregates", "operators.ranking",
    "operators.sets", "operators.leakage", "operators.claims", "operators.similar", "operators.scoring", "functions.text", "functions.dialogue", "functions.chat", "functions.hashing", "functions.dates", "operators.grading", "sources.files", "sources.generated", "streaming.sessions", "streaming.ordered", "streaming.upserts", "streaming.replays", "plans.artifacts", "plans.envelopes", "plans.merkle",
)

for _name in MODULES:
    importlib.import_module(f"corpusloom.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
