"""Structured Streaming: request scoring and monitoring."""
