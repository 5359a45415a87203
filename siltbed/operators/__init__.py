"""Dataflow operators on weighted points."""
