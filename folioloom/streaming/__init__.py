"""Streaming of folioloom."""
