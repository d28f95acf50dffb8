"""Every query of the survey with its SQL twin."""

from . import combine, extract, frontier, runs, tables  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
