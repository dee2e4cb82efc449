"""Readers and writers: CSV tables, polygon layers, pixel tables, scene catalogues."""
