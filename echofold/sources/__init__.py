"""Readers: tables, and payload columns as streams."""

from .tables import binary_files, streams, table

__all__ = ["binary_files", "streams", "table"]
