"""Registered queries over the driver's tables. Importing the package registers all of them."""

from . import areas, catalog, features, ground, network, pixels, scalars, series, stores, texts  # noqa: F401
from .adapters import WITH
from .registry import QUERIES, SQL

ORACLE = {name: sql if sql.lstrip().startswith("WITH") else WITH + sql for name, sql in SQL.items()}

__all__ = ["ORACLE", "QUERIES"]
