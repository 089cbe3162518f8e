"""All registered queries."""

from __future__ import annotations

from agropanel.plans import (  # noqa: F401
    intake_queries,
    model_queries,
    panel_queries,
    quality_queries,
    run_queries,
    scenario_queries,
    serving_queries,
    store_queries,
    weather_queries,
)
from agropanel.plans.registry import RUNS, SQL, Run


def queries() -> dict[str, Run]:
    return dict(RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
