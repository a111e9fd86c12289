"""Composed pipelines and the query catalogue."""

from __future__ import annotations

from collections.abc import Iterator

from marginalia.plans.catalogue import Catalogue


def all_catalogues() -> Iterator[Catalogue]:
    """The catalogues of the core, in order of registration."""
    from marginalia.plans import feature_queries, ingest_queries, more_queries, run_queries, step_queries, text_queries

    yield ingest_queries.CATALOGUE
    yield feature_queries.CATALOGUE
    yield text_queries.CATALOGUE
    yield step_queries.CATALOGUE
    yield more_queries.CATALOGUE
    yield run_queries.CATALOGUE
