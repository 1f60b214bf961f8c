"""Queries over the driver's tables, one per operator, with their SQL."""

from lamina.plans import upkeep as upkeep
from lamina.plans.queries import ORACLES, QUERIES

#: The query of the smoke check.
FLAGSHIP = "snapshot_merge"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "upkeep"]
