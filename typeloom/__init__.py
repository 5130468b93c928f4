"""Schema discovery for property graphs, as Spark DataFrame operations."""

from typeloom.model import PropertyGraph, endpoint_labels
from typeloom.plans import Schema, discover, discover_all, robustness_grid
from typeloom.streaming import discover_stream, schema_from_state

__all__ = [
    "PropertyGraph",
    "Schema",
    "discover",
    "discover_all",
    "discover_stream",
    "endpoint_labels",
    "robustness_grid",
    "schema_from_state",
]
