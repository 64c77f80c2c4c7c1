"""Operators of the document engine."""
