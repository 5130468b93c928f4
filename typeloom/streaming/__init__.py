"""Incremental discovery on Structured Streaming."""

from typeloom.streaming.incremental import discover_stream, schema_from_state, update_state

__all__ = ["discover_stream", "schema_from_state", "update_state"]
