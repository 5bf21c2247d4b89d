"""Structured Streaming jobs over deliveries of files."""
