"""Operators of a training-data pipeline on document, page and conversation tables."""
