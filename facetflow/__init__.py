"""Segment analytics as Spark jobs: meshes, masks, label maps, features and tracks as DataFrames."""
