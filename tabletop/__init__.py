"""Spark toolkit from scattered data sources to answered questions."""

from tabletop.session import build_session, register_tables

__all__ = ["build_session", "register_tables"]
