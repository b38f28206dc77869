"""Structured Streaming operators (inventory S1-S3)."""
