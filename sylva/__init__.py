"""sylva: document-graph analytics on Spark."""
