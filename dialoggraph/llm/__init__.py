"""Operators of a training-data pipeline over documents, benchmark passages, labels and vectors."""
