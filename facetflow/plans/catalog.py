"""Registered queries over the provided tables, and their SQL oracles."""

from __future__ import annotations

from facetflow.plans import detail_queries, feature_queries, lifting_queries, mask_queries, mesh_queries, pixel_queries, track_queries

PARTS = (lifting_queries, mesh_queries, mask_queries, track_queries, feature_queries, pixel_queries, detail_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
