"""Structured Streaming: parse, score, enrich, store."""
