"""Continuous checking with Structured Streaming."""
