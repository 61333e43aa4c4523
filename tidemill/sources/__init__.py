"""Readers: feeds, grids, workbooks, listings."""
