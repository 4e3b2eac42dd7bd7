"""Registered queries: every operator on tables derived from the driver's parquet files, with an SQL twin."""

from . import (  # noqa: F401
    catalog_queries,
    curve_queries,
    field_queries,
    grid_queries,
    mesh_queries,
    metadata_queries,
    pixel_queries,
    placement_queries,
    source_queries,
    validation_queries,
)
from .core import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
