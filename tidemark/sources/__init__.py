"""Readers, writers and the latest-wins upsert."""

from tidemark.sources import readers, sinks

__all__ = ["readers", "sinks"]
