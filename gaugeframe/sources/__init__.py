"""Readers, inline data, the report tree and the sinks."""
