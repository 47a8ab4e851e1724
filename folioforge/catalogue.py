"""All queries of the engine's own operators, with their SQL."""

from folioforge.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
