"""Streaming of the document-graph engine."""
