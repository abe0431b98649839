"""Readers, record formats and writers."""
