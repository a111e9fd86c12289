"""Relational operators: ingest, encoding, marginals, noise, divergence, windows."""
