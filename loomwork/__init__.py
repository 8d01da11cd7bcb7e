"""Loomwork: document-to-table extraction, matching and ranking as Spark DataFrame plans."""
