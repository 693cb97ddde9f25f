"""Functions of the document-graph engine."""
