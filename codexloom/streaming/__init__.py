"""Streaming of the document engine."""
