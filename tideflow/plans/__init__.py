"""Importing the families registers their queries."""

from tideflow.plans import domain, explain, flows, ingest, outcomes, overlap, pnl, replay, rotation, scalars, social, streams, windows  # noqa: F401
from tideflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
