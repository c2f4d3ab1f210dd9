"""Registered queries over the given tables and the SQL that states their results."""

from candlewright.catalog import checks, data, indicators, outcomes, stores, strategy, streams, trigger
from candlewright.catalog.base import REGISTRY

__all__ = ["REGISTRY", "checks", "data", "indicators", "outcomes", "stores", "strategy", "streams", "trigger"]
