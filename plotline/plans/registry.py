"""Queries by name and their SQL."""

from __future__ import annotations

from plotline.plans import parcel_queries, raster_queries, shape_queries

QUERIES = parcel_queries.QUERIES | raster_queries.QUERIES | shape_queries.QUERIES
ORACLE_SQL = parcel_queries.ORACLE_SQL | raster_queries.ORACLE_SQL | shape_queries.ORACLE_SQL
