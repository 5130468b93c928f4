"""Sources and sinks: wide tables, CSV files, parquet batches, documents."""

from typeloom.sources.batches import (
    edge_batches,
    node_batches,
    read_graph,
    write_batches,
    write_graph,
)
from typeloom.sources.csv_graph import read_csv_graph
from typeloom.sources.documents import write_lines
from typeloom.sources.wide import (
    align_wide,
    edges_from_wide,
    nodes_from_wide,
    property_keys,
    snapshot_labels,
    union_all,
)

__all__ = [
    "align_wide",
    "edge_batches",
    "edges_from_wide",
    "node_batches",
    "nodes_from_wide",
    "property_keys",
    "read_csv_graph",
    "read_graph",
    "snapshot_labels",
    "union_all",
    "write_batches",
    "write_graph",
    "write_lines",
]
