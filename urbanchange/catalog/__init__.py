"""Queries over the driver tables, and the same results as plain SQL for comparison."""
