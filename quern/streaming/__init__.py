"""Incremental relations in long-lived sessions, and their feed from streams."""
