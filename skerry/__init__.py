"""Spatial model evaluation and corpus processing as Spark jobs."""
