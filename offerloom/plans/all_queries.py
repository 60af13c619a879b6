"""Imports every module of queries, so that they are registered."""

from offerloom.plans import baskets, classification, ingests, listings, prices, scopes, shapes, sundry, views  # noqa: F401
from offerloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
