"""All queries on the driver's tables, by name."""

from . import measures, molecules, tables  # isort: skip
from . import files  # isort: skip  # reuses SQL of the others
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "files", "measures", "molecules", "tables"]
