"""Whole queries and the pipeline built from the operators."""
