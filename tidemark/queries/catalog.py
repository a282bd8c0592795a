"""Imports every query module, so the registry is complete."""

from . import (checks, context, labelling, runs, scoring, technical,  # noqa: F401
               views)
from .registry import INVENTORY, ORACLES, QUERIES

__all__ = ["INVENTORY", "ORACLES", "QUERIES"]
