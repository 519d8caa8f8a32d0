"""Searches over arriving vectors."""
