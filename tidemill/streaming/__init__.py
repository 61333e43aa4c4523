"""Feeds that arrive as streams."""
