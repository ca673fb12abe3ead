"""Queries over the given tables and their DuckDB twins."""

from debitage.plans import annotation_queries, evaluation_queries, file_queries, geometry_queries, segment_queries
from debitage.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotation_queries", "evaluation_queries", "file_queries", "geometry_queries", "segment_queries"]
