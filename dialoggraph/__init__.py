"""Typed dialogue graphs on Spark: build, merge, query, edit and guard them at corpus scale."""
