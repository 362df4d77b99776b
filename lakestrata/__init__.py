"""Incremental lakehouse operators on stock Spark: landing, bronze, silver, gold."""

from lakestrata.layout import Layout
from lakestrata.plans.lakehouse import Lakehouse
from lakestrata.sources.tables import Table

__all__ = ["Lakehouse", "Layout", "Table"]
