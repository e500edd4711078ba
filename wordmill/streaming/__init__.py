"""Structured Streaming versions."""
