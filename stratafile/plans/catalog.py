"""All queries: importing the modules registers them."""

from . import catalog_analyzers, catalog_content, catalog_exports, catalog_inventory, catalog_keys, catalog_reports, catalog_runs, catalog_state, catalog_support  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
