"""Operators of the document-graph engine."""
