"""Queries of the engine's operators by family; each module registers its own, with their SQL for DuckDB."""

from . import catalog, files, inventory, labels, links, media, models, names, readiness, runs, streams, textscan  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
