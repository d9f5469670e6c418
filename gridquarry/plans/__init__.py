"""The operators bound to the tables of a data folder, each beside its SQL."""

from __future__ import annotations

from . import aggregates, fields, joins, projections, rollouts, scores, series, sources, statistics, streams, topology
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "fields", "joins", "projections", "rollouts", "scores", "series", "sources", "statistics", "streams", "topology"]
