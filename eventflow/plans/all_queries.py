"""All registered queries in one place."""

from __future__ import annotations

from . import fleets, ingest, reactions, states, streams
from .reactions import open_tasks
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "fleets", "ingest", "open_tasks", "reactions", "states", "streams"]
