"""Operators that Spark has no single call for, composed of those it has."""

from tessera.operators.closure import closure
from tessera.operators.joins import asof_join, not_in, range_join
from tessera.operators.ordering import sessions, top_per_group
from tessera.operators.quantiles import exact_quantiles

__all__ = ["asof_join", "closure", "exact_quantiles", "not_in", "range_join", "sessions", "top_per_group"]
