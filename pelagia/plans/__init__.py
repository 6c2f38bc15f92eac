"""Registered queries."""


def load() -> None:
    """Import the modules that register queries."""
    from pelagia.plans import catalog_queries, error_queries, experiment_queries, pixel_queries, source_queries, sql_queries, stage_queries, store_queries, training_queries  # noqa: F401
