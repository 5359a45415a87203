"""Clustering of unbounded streams."""
