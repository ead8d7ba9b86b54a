"""Registered queries: each a Spark plan and, where SQL can say it, the same in SQL.

Names start with the inventory line they cover.
"""

from stationlab.catalogue import messages, relational, reporting, timeline, wording
from stationlab.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "messages", "relational", "reporting", "timeline", "wording"]
