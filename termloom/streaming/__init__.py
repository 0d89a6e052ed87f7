"""Incremental upkeep of index tables by Structured Streaming."""
