"""Queries over the driver's tables (``registry.QUERIES``) and their oracles."""
