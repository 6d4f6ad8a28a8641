"""The package's operators bound to the given tables, one named query each."""

from . import audits, converting, logs, moving, streams  # noqa: F401
from .registry import ORACLES, QUERIES, TABLES

__all__ = ["ORACLES", "QUERIES", "TABLES"]
