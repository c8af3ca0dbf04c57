"""Registered queries and their SQL."""

from landtide.plans import files, overlays, pixels, products, space, statistics, tiles, workflows
from landtide.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "overlays", "pixels", "products", "space", "statistics", "tiles", "workflows"]
