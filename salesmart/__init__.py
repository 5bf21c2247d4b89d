"""Retail sales analytics on Spark: clean, conform, report, forecast, replenish."""

from salesmart.model import RawTables, SalesFilter, Scope, Star

__all__ = ["RawTables", "SalesFilter", "Scope", "Star"]
