"""Whole pipelines and the registered query catalogue."""
