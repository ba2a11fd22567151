"""All queries of the engine, and the SQL that answers them alike."""

from . import alignment, claims, fitting, layout, misc, records, scoring, streams  # noqa: F401  these register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
