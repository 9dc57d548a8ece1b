"""Operators of folioloom."""
