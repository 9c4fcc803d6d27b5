"""Tables with every default of the schema filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tavola.functions.defaults import DEFAULTS, STATUS_COLUMNS, apply_defaults
from tavola.sources.domain import Domain

__all__ = ["DEFAULTS", "STATUS_COLUMNS", "apply_defaults", "customers_with_defaults"]


def customers_with_defaults(d: Domain) -> DataFrame:
    return apply_defaults(d.customers, "customers")
