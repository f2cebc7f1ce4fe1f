"""Incremental upkeep of results from tables that keep arriving."""
