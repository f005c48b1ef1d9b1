"""Loads every module that registers queries."""

from __future__ import annotations

from panelscope.plans import (  # noqa: F401
    accuracy_queries, learn_queries, pixel_queries, region_queries, source_queries, store_queries, verdict_queries,
)
from panelscope.plans.registry import callables, oracle  # noqa: F401
