"""Compositions of operators: ingest, metadata and search."""
