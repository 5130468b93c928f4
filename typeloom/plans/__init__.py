"""Whole discovery runs."""

from typeloom.plans.discovery import Schema, discover, discover_all
from typeloom.plans.robustness import damaged, robustness_grid

__all__ = ["Schema", "damaged", "discover", "discover_all", "robustness_grid"]
