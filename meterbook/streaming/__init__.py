"""Incremental import on Structured Streaming."""
