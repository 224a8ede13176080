"""Queries over the provided tables, with oracle SQL."""

from importlib import import_module

MODULES = ("curve_queries", "cohort_queries", "structure_queries", "order_queries", "mining_queries", "model_queries", "price_queries", "post_queries", "source_queries")


def load() -> None:
    for m in MODULES:
        import_module(f"launchlens.catalog.{m}")
